"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python loop per word.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return; A-Z count as a-z. NULL texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; longer documents are hashed alone.
CHUNK = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


class Words(NamedTuple):
    """Hashes of the words of some documents, their byte ranges, and where each document's words begin."""

    first: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of other byte ranges, equal where the bytes are."""
        inverse = _powers_to(len(self.data) + 1)[1]
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; NULL is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def parts(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of a string column, rows of about ``size`` bytes at a time."""
    data, offsets = buffers(column)
    first, rows = 0, len(column)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Words]:
    """The words of a string column, some rows at a time."""
    for first, data, offsets in parts(column, size):
        yield _words(first, data, offsets)


def _words(first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    n, none = len(data), np.zeros(0, np.int64)
    if n == 0:
        return Words(first, data, none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64), np.zeros(1, np.uint64))
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers_to(n + 1)[0][:n], out=sums[1:])
    part = Words(first, data, none.astype(np.uint64), starts, ends, np.searchsorted(starts, offsets), sums)
    return part._replace(hashes=part.hash(starts, ends))
