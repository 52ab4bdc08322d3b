"""Variable-capacity best-fit packing: several permitted sequence lengths at once.

Documents longer than the largest length fill whole sequences; what remains of
every document is dealt by hash into blocks, and each block is packed by best-fit
decreasing. When nothing open fits, the size of least cost per expected token is
opened; at the end a bin shrinks to the smallest length that holds its contents.
Each block tries every largest size it may open and keeps the cheapest packing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.words import SPACE, parts
from worklens.session import checkpoint

CAPACITIES = (512, 1024, 2048, 4096)
#: Tokens that a sequence costs besides its capacity.
OVERHEAD = 16
#: Remainders per block: what one task holds in memory.
BLOCK_PIECES = 10_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words of the whole text and one end token; a NULL or empty text has the end token alone.
    An empty table gives no rows; texts are taken whole at any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.ones(batch.num_rows, np.int64)
            for row, data, offsets in parts(batch.column(1)):
                inside = ~SPACE[data]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                first = offsets[:-1][offsets[:-1] < len(data)]
                begins[first] = inside[first]
                counts[row : row + len(offsets) - 1] += np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def best_fit(sizes: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """Pack falling ``sizes``: for each its bin and place in it; for each bin its final capacity."""
    largest = capacities[-1]
    best = None
    for limit in capacities:
        if sizes and sizes[0] > limit:
            continue
        allowed = [c for c in capacities if c <= limit]
        free: list[list[int]] = [[] for _ in range(largest + 1)]
        mask, rest = 0, sum(sizes)
        home, place, used = [], [], []
        for size in sizes:
            fits = mask >> size
            if fits:
                gap = size + (fits & -fits).bit_length() - 1
                k = free[gap].pop()
                if not free[gap]:
                    mask ^= 1 << gap
                gap -= size
            else:
                opened = min((c for c in allowed if c >= size), key=lambda c: ((c + overhead) / min(c, rest), c))
                k, gap = len(used), opened - size
                used.append(0)
            home.append(k)
            place.append(used[k])
            used[k] += size
            rest -= size
            if gap:
                free[gap].append(k)
                mask |= 1 << gap
        final = [next(c for c in capacities if c >= u) for u in used]
        cost = sum(final) + overhead * len(final)
        if best is None or cost < best[0]:
            best = cost, home, place, final
    return best[1:] if best else ([], [], [])


def packed(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pieces of ``lengths`` (doc_id, n_tokens) in sequences: doc_id, start, n_tokens, bin_id, capacity, place.

    ``start`` is the piece's first token in its document, ``place`` its first
    token in the bin. Every token is in one piece; no bin holds more than its
    ``capacity``, which is the smallest permitted one for its contents. Rows of
    no tokens (or NULL) give no piece. Repeated rows are packed one by one.
    Without pieces there are no rows. Other columns are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    largest = capacities[-1]
    rows = checkpoint(lengths.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row")).where("n_tokens > 0"))
    whole = rows.where(F.col("n_tokens") >= largest).select(
        "doc_id", "row", F.explode(F.sequence(F.lit(1), F.expr(f"n_tokens div {largest}"))).alias("k")
    ).select(
        "doc_id", ((F.col("k") - 1) * largest).alias("start"), F.lit(largest).cast("long").alias("n_tokens"),
        F.concat_ws("-", F.lit("whole"), "row", "k").alias("bin_id"), F.lit(largest).alias("capacity"), F.lit(0).cast("long").alias("place"),
    )
    rests = rows.select("doc_id", "row", F.expr(f"n_tokens % {largest}").alias("size"), F.expr(f"(n_tokens div {largest}) * {largest}").alias("start")).where("size > 0")
    blocks = max(1, -(-rests.count() // block_pieces))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "row"], ascending=[False, True])
        home, place, final = best_fit(block["size"].tolist(), capacities, overhead)
        name = f"mixed-{block['block'].iloc[0]}-"
        return pd.DataFrame({
            "doc_id": block["doc_id"].astype("Int64"), "start": block["start"], "n_tokens": block["size"], "bin_id": [f"{name}{k}" for k in home],
            "capacity": [final[k] for k in home], "place": place,
        })

    mixed = rests.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInPandas(
        pack, "doc_id long, start long, n_tokens long, bin_id string, capacity int, place long"
    )
    return whole.unionByName(mixed)
