"""Toxicity scores by a factorization machine over hashed terms.

Terms are words without the punctuation at their ends, hashed into ``BUCKETS``. Of these the
``TERMS`` that part the labelled classes best (by the deviation of their document
frequencies) get a weight and a short vector; the inner products of
the vectors of terms in one text are what a sum of weights cannot express. Scores are
shifted so that the cut of best F1 on the sample lies at ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.fitting import SAMPLE, labelled, remainder
from worklens.llm.words import Words, chunks, mix
from worklens.session import checkpoint

BUCKETS, TERMS, FACTORS = 1 << 20, 1024, 4
#: Passes over the sample at least, and gradient steps at least.
PASSES, STEPS = 40, 1500
CUT = 0.3

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _bare(part: Words) -> np.ndarray:
    """Hashed buckets of the words without punctuation at their ends."""
    starts, ends = part.starts.copy(), part.ends.copy()
    for _ in range(3):
        ends -= _PUNCTUATION[part.data[ends - 1]] & (ends - starts > 1)
        starts += _PUNCTUATION[part.data[starts]] & (ends - starts > 1)
    return (mix(part.hash(starts, ends)) % np.uint64(BUCKETS)).astype(np.int64)


def terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct buckets of the whole text)."""
    for part in chunks(column):
        found = _bare(part) if len(part.starts) else np.zeros(0, np.int64)
        for i in range(len(part.bounds) - 1):
            yield part.first + i, np.unique(found[part.bounds[i] : part.bounds[i + 1]])


class Model(NamedTuple):
    """``slot`` gives a bucket its row in ``weights`` and ``vectors``; the last row is all zeros."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for row, found in terms(column):
            s = self.slot[found]
            s = s[s < len(self.weights) - 1]
            if len(s):
                v = self.vectors[s]
                out[row] += self.weights[s].sum() + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, seed: int = 6) -> Model:
    """Logistic loss by adaptive gradient steps over texts as rows of chosen terms; one class alone gives its share."""
    slot = np.full(BUCKETS, len(chosen), np.int32)
    slot[chosen] = np.arange(len(chosen))
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    weights, random = np.zeros(len(chosen) + 1), np.random.default_rng(seed)
    vectors = random.normal(0, 0.05, (len(chosen) + 1, FACTORS))
    vectors[-1] = 0
    if len(np.unique(y)) < 2 or not len(chosen):
        return Model(slot, bias, weights, vectors * 0)
    rows = [slot[t] for t in texts]
    g_b, g_w, g_v = 1e-3, np.full(weights.shape, 1e-3), np.full(vectors.shape, 1e-3)
    batch = 256
    passes = max(PASSES, -(-STEPS * batch // len(rows)))
    for k in range(passes):
        order = random.permutation(len(rows))
        rate = 0.15 / (1 + 4 * k / passes)
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            at = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            s = np.concatenate([rows[i] for i in some])
            v = vectors[s]
            total = np.zeros((len(some), FACTORS))
            np.add.at(total, at, v)
            raw = bias + np.bincount(at, weights[s], len(some)) + 0.5 * ((total * total).sum(1) - np.bincount(at, (v * v).sum(1), len(some)))
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]
            e = error[at] / len(some)
            d_w = np.bincount(s, e, len(weights)) + 2e-5 * weights
            d_v = np.zeros_like(vectors)
            np.add.at(d_v, s, e[:, None] * (total[at] - v))
            d_v += 2e-4 * vectors
            d_w[-1], d_v[-1], d_b = 0, 0, error.mean()
            g_b, g_w, g_v = g_b + d_b * d_b, g_w + d_w * d_w, g_v + d_v * d_v
            bias -= rate * d_b / np.sqrt(g_b)
            weights -= rate * d_w / np.sqrt(g_w)
            vectors -= 0.3 * rate * d_v / np.sqrt(g_v)
    raw = np.array([bias + weights[r].sum() + 0.5 * float((vectors[r].sum(0) ** 2 - (vectors[r] ** 2).sum(0)).sum()) for r in rows])
    return Model(slot, float(bias) + np.log(CUT / (1 - CUT)) - best_cut(raw, y), weights, vectors)


def best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The raw score that parts the classes with the best F1, halfway between its neighbours."""
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    at = int(np.argmax(2 * hits / (np.arange(1, len(raw) + 1) + y.sum())))
    return float((raw[order[at]] + raw[order[min(at + 1, len(raw) - 1)]]) / 2)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms_kept: int = TERMS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from at most ``sample`` labelled rows of ``labels`` (doc_id, toxic) outside the held-out fold
    (crc32 of doc_id as text mod 4 is 2); only the text is scored. ``predicted`` is
    1 from a score of 0.3. Empty and NULL texts have no terms and get the
    score of the bias. A NULL doc_id is not held out. Repeated rows are scored
    one by one. Without labels of both kinds every score is their share (0.5 without any).
    An empty table gives no rows; texts are taken whole at any length. Other columns are ignored.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.astype(np.int32) for _, t in terms(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["terms", "y"])

    known = checkpoint(labelled(docs, labels, "toxic", 4, 2, sample).select("text", "y").mapInArrow(listed, "terms array<int>, y int"))
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = known.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("dy"))
    share = positive / n if n else 0.5
    spread = F.sqrt(F.col("df") * F.lit(share * (1 - share)) * F.greatest(F.lit(0.0), 1 - F.col("df") / F.lit(max(n, 1))) + 1e-9)
    best = counts.where("df > 2").withColumn("z", F.abs(F.col("dy") - F.col("df") * share) / (spread + 0.5)).orderBy(F.desc("z"), "term").limit(terms_kept)
    chosen = np.sort(np.array([r.term for r in best.select("term").collect()], np.int64))
    slim = known.select(F.array_intersect("terms", F.array(*[F.lit(int(t)) for t in chosen])).alias("terms"), "y") if len(chosen) else known.select(F.array().cast("array<int>").alias("terms"), "y")
    rows = sorted((tuple(sorted(r.terms)), r.y) for r in slim.collect())
    model = fit([np.array(t, np.int64) for t, _ in rows], np.array([y for _, y in rows], float), chosen)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(batch.column(2)))], ["doc_id", "held_out", "score"])

    held = F.coalesce(remainder(4) == 2, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
