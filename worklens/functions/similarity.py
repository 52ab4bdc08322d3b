"""String similarity of names: token-sort and token-set ratio, 0 to 100.

Both rest on the insert/delete similarity ``100 * 2 * LCS / (|a| + |b|)``.
Spark hands the functions Arrow batches of the pairs that survived the joins; the
pairs of a batch are measured together in NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .base import text


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_many(a: list[str], b: list[str], block: int = 4096) -> np.ndarray:
    """``lcs`` of many pairs: the bits of all pairs move together, one step per character. Pairs of two long texts go one by one."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short = [i for i, (x, _) in enumerate(pairs) if 0 < len(x) <= 64]
    for i, (x, y) in enumerate(pairs):
        if len(x) > 64:
            out[i] = lcs(x, y)
    for at in range(0, len(short), block):
        some = short[at : at + block]
        x, x_len = _codes([pairs[i][0] for i in some])
        y, y_len = _codes([pairs[i][1] for i in some])
        # Characters as numbers; 0 is the padding, which no mask holds.
        known, number = np.unique(np.concatenate((x.ravel(), y.ravel())), return_inverse=True)
        x, y = number[: x.size].reshape(x.shape), number[x.size :].reshape(y.shape)
        rows = np.arange(len(some))
        masks = np.zeros((len(some), len(known)), np.uint64)
        for i in range(x.shape[1]):
            masks[rows, x[:, i]] |= np.uint64(1) << np.uint64(i)
        if known[0] == 0:
            masks[:, 0] = 0
        state = np.full(len(some), np.iinfo(np.uint64).max, np.uint64)
        for j in range(y.shape[1]):
            hit = state & masks[rows, y[:, j]]
            state = (state + hit) | (state - hit)
        unused = np.uint64(64) - x_len.astype(np.uint64)
        out[some] = x_len - np.bitwise_count((state << unused) >> unused)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points + 1 of texts, padded with 0, and their lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(lengths.max())), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    return out, lengths


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Insert/delete similarity of many pairs; 100 for two empty texts."""
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(size == 0, 100.0, 200.0 * lcs_many(a, b) / np.maximum(size, 1))


def token_sorts(a: list[str], b: list[str]) -> np.ndarray:
    ordered = lambda t: " ".join(sorted(t.split()))
    return ratios([ordered(x) for x in a], [ordered(y) for y in b])


def company_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Set ratio of two names (the best among their common words alone and with the rest of either side), 0 against a missing one, 100 when both are missing."""
    out = np.array([100.0 if not x.split() and not y.split() else 0.0 for x, y in zip(a, b, strict=True)])
    at, base, rest_x, rest_y = [], [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        own, other = set(x.split()), set(y.split())
        if not own or not other:
            continue
        common = own & other
        if common and (own <= other or other <= own):
            out[i] = 100.0
            continue
        at.append(i)
        base.append(len(" ".join(common)))
        rest_x.append(" ".join(sorted(own - other)))
        rest_y.append(" ".join(sorted(other - own)))
    if at:
        alone = np.array(base, np.int64)
        len_x, len_y = (alone + (alone > 0) + [len(t) for t in rest] for rest in (rest_x, rest_y))
        apart = np.array([len(x) + len(y) for x, y in zip(rest_x, rest_y, strict=True)]) - 2 * lcs_many(rest_x, rest_y)
        best = 100.0 - 100.0 * apart / (len_x + len_y)
        for n in (len_x, len_y):
            best = np.where(alone > 0, np.maximum(best, 100.0 - 100.0 * (n - alone) / (alone + n)), best)
        out[at] = best
    return out


def _pairwise(measure):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(measure(a.tolist(), b.tolist()), dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return pandas_udf(run, "double")


def plain_ratio(a: Column, b: Column) -> Column:
    return _pairwise(ratios)(text(a), text(b))


def sort_ratio(a: Column, b: Column) -> Column:
    return _pairwise(token_sorts)(text(a), text(b))


def name_ratio(a: Column, b: Column) -> Column:
    return _pairwise(company_ratios)(text(a), text(b))


def sorted_words(c: Column) -> Column:
    """Words in order, with one blank between."""
    return F.array_join(F.array_sort(F.filter(F.split(text(c), r"\s+"), lambda w: w != "")), " ")


def bigrams(c: Column) -> Column:
    """Distinct two-character pieces of a text; a shorter text is its own piece."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) >= 2, F.array_distinct(pieces)).otherwise(F.array(c))
