"""Runs of repeated words: recursive frequency splitting, then a scan of lags over what survives.

A run is a longest stretch of words with smallest period q (words q apart are the
same) and at least max(6, 4 q) words. Each of its words stands in it four times or more. So a
word that a segment holds less often is in no run of that segment and splits it; the
parts are split again until nothing changes. Most text is gone by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from worklens.llm.words import SPACE, mix, parts

#: A run has this many periods at least, and this many words.
PERIODS, WORDS = 4, 6
#: Lags up to this are compared at every place; above, windows of so many words at every lag-th place.
DENSE = 16


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte ranges of the words of some texts, and where each text's words begin."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal where the bytes are: exact, by a dictionary."""
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    # Words without what parts them: bytes of word w move left by starts[w] - offsets[w].
    held = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def segments(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [low, high) of words that may hold a run; ``owner`` is the text of each word, in rising order.

    A round counts words per segment, takes out those that are too rare, and goes on
    with the segments that lost words; one that loses none is final.
    """
    final: list[tuple[int, int]] = []
    place, segment = np.arange(len(ids)), owner
    while len(place):
        order = np.lexsort((ids[place], segment))
        s, w = segment[order], ids[place][order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])))
        group = np.cumsum(new) - 1
        many = np.empty(len(place), bool)
        many[order] = np.bincount(group)[group] >= PERIODS
        # New segments: stretches of places that follow each other in one old segment and stay.
        edge = np.concatenate(([True], (np.diff(place) != 1) | (np.diff(segment) != 0)))
        edge |= np.concatenate(([True], ~many[:-1]))
        part = np.cumsum(edge & many) - 1
        old = np.cumsum(np.concatenate(([True], np.diff(segment) != 0))) - 1
        lost = np.bincount(old, weights=~many) > 0
        place, part, changed = place[many], part[many], lost[old][many]
        if len(place) == 0:
            break
        sizes = np.bincount(part)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for k in np.flatnonzero((sizes >= WORDS) & ~changed[first]):
            final.append((int(place[first[k]]), int(place[first[k]]) + int(sizes[k])))
        again = changed & (sizes[part] >= WORDS)
        place, segment = place[again], part[again]
    return sorted(final)


def _stretch(w: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The longest [low, high) around ``at`` in which w[i] = w[i + lag], by steps that double."""
    low, step = at, 64
    while low > 0:
        a = max(0, low - step)
        other = np.flatnonzero(w[a:low] != w[a + lag : low + lag])
        if len(other):
            low = a + int(other[-1]) + 1
            break
        low, step = a, step * 2
    high, step, last = at, 64, len(w) - lag
    while high < last:
        b = min(last, high + step)
        other = np.flatnonzero(w[high:b] != w[high + lag : b + lag])
        if len(other):
            high += int(other[0])
            break
        high, step = b, step * 2
    return low, high


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment, by start, then period.

    Lags rise, so a run is met with its smallest period first. A lag q above DENSE is
    looked at in every q-th place only: the 3 q equal pairs of a run hold two such places in a row
    whose windows of DENSE words equal those q behind. A place that lies 2 q deep in a run of a
    smaller period shows that run's own multiple, and nothing else.
    """
    n, found, seen = len(w), [], set()
    reach = np.zeros(n, np.int64)

    def add(low: int, high: int, lag: int) -> None:
        start, length = low, high - low + lag
        if length >= max(WORDS, PERIODS * lag) and (start, length) not in seen:
            seen.add((start, length))
            found.append((start, length, lag))
            np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])

    for lag in range(1, min(DENSE, n // PERIODS) + 1):
        same = np.zeros(n - lag + 2, np.int8)
        same[1:-1] = w[lag:] == w[:-lag]
        steps = np.diff(same)
        lows, highs = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        for k in np.flatnonzero(highs - lows + lag >= max(WORDS, PERIODS * lag)):
            add(int(lows[k]), int(highs[k]), lag)
    if n // PERIODS > DENSE:
        window = np.zeros(n - DENSE + 1, np.uint64)
        for k in range(DENSE):
            window = mix(window * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(window)].astype(np.uint64))
        for lag in range(DENSE + 1, n // PERIODS + 1):
            marks = window[::lag]
            same = marks[1:] == marks[:-1]
            hits = np.flatnonzero(same[1:] & same[:-1]) * lag
            done = -1
            for at in hits[reach[hits] < hits + 2 * lag].tolist() if len(hits) else ():
                if at >= done:
                    low, high = _stretch(w, lag, at)
                    done = high
                    add(low, high, lag)
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length per period, compared exactly; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = "struct<start:long,length:long,period:long>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs, strongest, collapsed.

    ``runs`` lists (start, length, period) in words, by start, then period; ``strongest`` is the run with
    most periods (NULL without runs); ``collapsed`` is the text's words joined by one blank, without
    those that a run holds after its first period. Words are compared as they are written. NULL, empty and blank texts have no words,
    no runs and an empty ``collapsed``; texts are read whole at any length. Repeated rows each come back, a NULL
    doc_id stays NULL, an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
        for batch in batches:
            counts, listed, best, texts = [], [], [], []
            for _, data, offsets in parts(batch.column(1)):
                starts, ends, bounds = split_words(data, offsets)
                ids = word_ids(data, starts, ends)
                rows = np.diff(bounds)
                owner = np.repeat(np.arange(len(rows)), rows)
                of: dict[int, list[tuple[int, int, int]]] = {}
                dropped = np.zeros(len(ids) + 1, np.int64)
                for low, high in segments(ids, owner):
                    row = int(owner[low])
                    for start, length, period in runs_of(ids[low:high]):
                        of.setdefault(row, []).append((low + start - int(bounds[row]), length, period))
                        dropped[low + start + period] += 1
                        dropped[low + start + length] -= 1
                keep = np.cumsum(dropped[:-1]) == 0
                counts.append(rows)
                for row in range(len(rows)):
                    listed.append(of.get(row, []))
                    best.append(strongest(of[row]) if row in of else None)
                texts += _joined(data, starts[keep], ends[keep], np.concatenate(([0], np.cumsum(keep)))[bounds])
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(listed, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string")


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The words of each text joined by one blank."""
    lengths = ends - starts + 1
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    out = np.full(offsets[-1], 32, np.uint8)
    at = np.arange(offsets[-1] - len(starts))
    word = np.repeat(np.arange(len(starts)), lengths - 1)
    # Byte ``at`` of all kept words stands behind ``word`` blanks.
    out[at + word] = data[at + np.repeat(starts - offsets[:-1] + np.arange(len(starts)), lengths - 1)] if len(starts) else np.zeros(0, np.uint8)
    held = out.tobytes()
    return [held[offsets[bounds[i]] : max(offsets[bounds[i]], offsets[bounds[i + 1]] - 1)] for i in range(len(bounds) - 1)]
