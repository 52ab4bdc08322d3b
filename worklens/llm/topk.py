"""Exact top-k inner products by block-at-a-time pruning over document-range blocks.

Vectors are put in a locality order (largest components first) and cut into
blocks, which keep their rows as a matrix (a forward index) and the extremes of
each term. The sum over terms of the larger product with an extreme bounds every score in a block.
Per query, blocks are scored by falling bound until the bound falls below the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.session import checkpoint

BLOCK = 256
_LAST = (1 << 63) - 1
#: Rows per shard and queries per slice; a task holds one of each.
SHARD, SLICE = 4096, 1024


def integer_vectors(embeddings: DataFrame, column: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; NULL vectors, those with NULL or non-finite components, and rows without id take no part.

    Of rows with the same id the smallest vector counts.
    """
    x = F.col(column)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & whole).select("vec_id", F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    lengths = np.asarray(pc.list_value_length(vectors).fill_null(0), np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.asarray(vectors.flatten(), np.int64)
    return out


def _exact(m: np.ndarray, largest: int) -> np.ndarray:
    """A type in which all sums of products are exact."""
    bound = largest * largest * max(1, m.shape[1])
    return m.astype(np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object)


class Shard:
    """Blocks of rows, ids rising within each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: int):
        self.blocks = []
        for a in range(0, len(ids), BLOCK):
            order = np.argsort(ids[a : a + BLOCK]) + a
            self.blocks.append((ids[order], rows[order]))
        self.high = np.stack([m.max(0) for _, m in self.blocks])
        self.low = np.stack([m.min(0) for _, m in self.blocks])
        self.largest = largest

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query its best (ids, scores) here, at most ``k``, of those before (``kth``, ``kth_id``) by falling score and rising id; rows of the query's own id are passed over."""
        q = _exact(queries, self.largest)
        bounds = _exact(np.maximum(queries, 0), self.largest) @ _exact(self.high, self.largest).T + _exact(np.minimum(queries, 0), self.largest) @ _exact(self.low, self.largest).T
        bounds = bounds.astype(np.float64) if bounds.dtype != object else bounds
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = [(np.zeros(0, np.int64), np.zeros(0, bounds.dtype))] * len(ids)
        kth, kth_id = kth.astype(bounds.dtype), kth_id.copy()
        blocks = [_exact(m, self.largest) for _, m in self.blocks]
        for turn in range(len(self.blocks)):
            mine = order[:, turn]
            live = np.flatnonzero(bounds[np.arange(len(ids)), mine] >= kth)
            if not len(live):
                break
            for b in np.unique(mine[live]):
                some = live[mine[live] == b]
                scores = (q[some] @ blocks[b].T).astype(bounds.dtype)
                there = self.blocks[b][0]
                for i, row in zip(some, scores, strict=True):
                    good = np.flatnonzero(((row > kth[i]) | (row == kth[i]) & (there <= kth_id[i])) & (there != ids[i]))
                    if len(good):
                        d, s = np.concatenate([best[i][0], there[good]]), np.concatenate([best[i][1], row[good]])
                        top = np.lexsort((d, -s))[:k]
                        best[i] = d[top], s[top]
                        if len(top) == k and (s[top[-1]] > kth[i] or d[top[-1]] < kth_id[i]):
                            kth[i], kth_id[i] = s[top[-1]], d[top[-1]]
        return best


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` best of all other rows for every row of ``vectors`` (vec_id, v) with vec_id divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (integer inner product); ties go to the
    smaller id, fewer than ``k`` candidates are all returned. Shorter vectors count as filled with zeros. An empty
    table gives no rows.
    """
    vectors = checkpoint(vectors)
    number, width, largest = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0))).first()
    width, shards = max(1, width), max(1, -(-number // SHARD))
    top = F.array_sort(F.transform("v", lambda c, i: F.struct((-F.abs(c)).alias("a"), i.alias("i"), c.alias("c"))))
    place = lambda j: F.coalesce(F.get(top, F.lit(j))["i"] * 2 + (F.get(top, F.lit(j))["c"] > 0).cast("int"), F.lit(0))
    ordered = vectors.withColumn("near", place(0) * 2 * width + place(1)).repartitionByRange(shards, "near", "vec_id").sortWithinPartitions("near", "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SHARD):
                part = batch.slice(a, SHARD)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column(0), np.int64).tobytes()]), pa.array([_matrix(part.column(1), width).tobytes()])], ["ids", "rows"])

    stored = checkpoint(checkpoint(ordered.select("vec_id", "v").mapInArrow(cut, "ids binary, rows binary")).select(F.monotonically_increasing_id().alias("place"), "ids", "rows"))
    opened = lambda ids, rows: (np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64).reshape(-1, width))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th best score among the rows near them, which bounds the true one from below."""
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows = opened(row["ids"], row["rows"])
                asked = np.flatnonzero(ids % every == 0)
                if len(asked):
                    found = Shard(ids, rows, largest).search(ids[asked], rows[asked], k, np.full(len(asked), -np.inf), np.full(len(asked), _LAST))
                    last = [(int(s[-1]), int(d[-1])) if len(s) == k else (None, _LAST) for d, s in found]
                    kth, kth_id = pa.array([x for x, _ in last], pa.int64()), pa.array([x for _, x in last], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array([r.tobytes() for r in rows[asked]], pa.binary()), kth, kth_id], ["query_id", "query", "kth", "kth_id"])

    queries = checkpoint(stored.mapInArrow(at_home, "query_id long, query binary, kth long, kth_id long"))
    slices = max(1, -(-queries.count() // SLICE))
    places = sorted(r[0] for r in stored.select("place").collect())  # one number per SHARD rows
    # Every slice of the stated queries meets every shard: the queries go out once per shard, the shards once per slice.
    shared = stored.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = queries.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")).withColumn("place", F.explode(F.array(*[F.lit(p) for p in places]).cast("array<long>")))

    def meet(key: tuple, shard: pa.Table, some: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if shard.num_rows and some.num_rows:
            ids, rows = opened(shard["ids"][0].as_py(), shard["rows"][0].as_py())
            asking = np.asarray(some["query_id"], np.int64)
            vectors = np.stack([np.frombuffer(q, np.int64) for q in some["query"].to_pylist()])
            kth = np.array([-np.inf if x is None else x for x in some["kth"].to_pylist()])
            for i, (d, s) in zip(asking, Shard(ids, rows, largest).search(asking, vectors, k, kth, np.asarray(some["kth_id"], np.int64)), strict=True):
                out_q.append(np.full(len(d), i))
                out_v.append(d)
                out_s.append(s)
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.table({"query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)})

    keys = ("slice", "place")
    found = shared.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
