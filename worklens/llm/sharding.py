"""Longest-processing-time sharding: groups that must stay together, by falling size, to the least-loaded shard of a heap.

Groups above a bounded share of a shard (at most ``shards * FINE`` of them can
exist) are placed first by one heap. The rest is dealt by hash into blocks; each
block runs its own heap, which starts from the loads that the large groups left,
divided by the number of blocks, so the blocks together level them out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.session import checkpoint

#: Groups per block: what one task holds in memory (24 bytes each).
BLOCK_GROUPS = 20_000
#: A group of more than a shard's even load divided by this is placed before the blocks.
FINE = 500


def longest_first(sizes: list[int], loads: list[float]) -> list[int]:
    """A shard for each size, largest first (ties by place), always the least loaded (ties to the smaller number)."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, k = heap[0]
        out[i] = k
        heapq.heapreplace(heap, (load + sizes[i], k))
    return out


def _turned(sizes: list[int], loads: list[float], by: int) -> list[int]:
    """As ``longest_first``, with shard ``by`` first among ties, so that no shard gains from its number in every block."""
    n = len(loads)
    return [(k + by) % n for k in longest_first(sizes, [loads[(k + by) % n] for k in range(n)])]


def balanced_shards(docs: DataFrame, shards: int = 40, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (NULL: none) plus 16. Rows of equal text
    share a shard; rows without text are no copies of each other and are dealt one by one (by
    doc_id), with a NULL text_crc32. ``slot`` counts a shard's rows from 0 without gaps.
    The law is ``bytes``: near equal sums of sizes, as far as a single group leaves room. Repeated
    rows get a slot each. An empty table gives no rows.
    An empty table gives no rows; texts are taken whole at any length. Other columns are ignored.
    """
    rows = checkpoint(docs.select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(16)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")).alias("group"), F.xxhash64("doc_id", "text").alias("dealt"),
    ))
    groups = checkpoint(rows.groupBy("group", F.col("text_crc32").isNull().alias("bare")).agg(F.sum("size").alias("bytes")))
    total, number = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-number // block_groups))
    line = total / (shards * FINE)
    large = groups.where(F.col("bytes") > line).orderBy(F.desc("bytes"), "group", "bare").collect()
    placed = longest_first([g.bytes for g in large], [0.0] * shards)
    loads = [0.0] * shards
    for g, k in zip(large, placed, strict=True):
        loads[k] += g.bytes
    start = [(load - min(loads)) / blocks for load in loads]

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["bytes", "group", "bare"], ascending=[False, True, True])
        block["shard"] = _turned(block["bytes"].tolist(), start, int(block["block"].iloc[0]) % shards)
        return block[["group", "bare", "shard"]]

    small = groups.where(F.col("bytes") <= line).withColumn("block", F.pmod(F.xxhash64("group", F.lit("block")), F.lit(blocks)))
    homes = small.groupBy("block").applyInPandas(fill, "group long, bare boolean, shard int")
    spark = docs.sparkSession
    homes = checkpoint(homes.unionByName(spark.createDataFrame([(g.group, g.bare, k) for g, k in zip(large, placed, strict=True)], "group long, bare boolean, shard int")))
    housed = checkpoint(rows.withColumn("bare", F.col("text_crc32").isNull()).join(homes, ["group", "bare"]).select("doc_id", "size", "text_crc32", "dealt", "shard"))
    return numbered(housed, "shard", F.col("dealt"), max(1, -(-number // block_groups))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def numbered(rows: DataFrame, key: str, dealt, cells: int) -> DataFrame:
    """``slot`` from 0 without gaps within ``key``: rows are numbered in ``cells`` cells per key, which follow each other by their counts."""
    rows = rows.withColumn("_cell", F.pmod(dealt, F.lit(cells)))
    counts = rows.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_cell").orderBy("dealt", "doc_id")
    return rows.withColumn("_at", F.row_number().over(inside)).join(before, [key, "_cell"]).withColumn("slot", (F.col("_before") + F.col("_at") - 1).cast("long"))
