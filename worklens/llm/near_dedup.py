"""MinHash near duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Rows with equal shingle sets collapse first, so a group of copies costs one
row. In every bucket the members are compared with one centre only (a star): the
member that meets most others over all bands. Candidates are confirmed on full sets. Members
that still share a bucket across components are compared exactly, by a join on the rarest
shingles of each set (a prefix filter), so no bucket hides a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.components import components
from worklens.llm.words import chunks, mix
from worklens.session import checkpoint, release, sweep

#: Bands and values per band: a pair of similarity 0.8 misses all 32 bands with probability 5e-8.
BANDS, ROWS = 32, 4
_PROBES = 64
#: Shingles are put in order of rarity by counts of so many hashed bins; the order decides only how many candidates arise.
_BINS = 1 << 18


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles); a text of fewer words is one shingle, none without words."""
    for part in chunks(column):
        h = part.hashes
        run = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(run)])
        for i in range(len(part.bounds) - 1):
            a, b = int(part.bounds[i]), int(part.bounds[i + 1])
            if b - a >= words:
                yield part.first + i, np.unique(run[a : b - words + 1])
            elif b > a:
                whole = reduce(lambda x, w: mix(x * np.uint64(31) + w), np.split(h[a:b], b - a), np.full(1, b - a, np.uint64))
                yield part.first + i, whole
            else:
                yield part.first + i, np.zeros(0, np.uint64)


class Signer:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        random = np.random.default_rng(8)
        self.edges = (np.arange(self.bins, dtype=np.float64) * (2.0**64 / self.bins)).astype(np.uint64)
        self.probes = random.integers(0, self.bins, (self.bins, _PROBES))
        self.odd = random.integers(1, 1 << 62, self.bins, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(shingles, self.edges)
        full = np.append(at[1:], len(shingles)) > at
        values = shingles[np.minimum(at, len(shingles) - 1)]
        if not full.all():
            # Optimal densification: an empty bin takes the value of the first full bin in its own random order.
            empty = np.flatnonzero(~full)
            hits = full[self.probes[empty]]
            source = self.probes[empty, hits.argmax(1)]
            late = ~hits.any(1)
            if late.any():
                there = np.flatnonzero(full)
                source[late] = there[mix(empty[late].astype(np.uint64)) % np.uint64(len(there))]
            values[empty] = values[source]
        return mix((mix(values) * self.odd).reshape(self.bands, self.rows).sum(1, dtype=np.uint64) + self.band)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per document: set size, a 128-bit fingerprint of the set, and its band hashes (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            size, low, high, marks = [], [], [], []
            for _, s in shingle_sets(batch.column(1), words):
                size.append(len(s))
                low.append(s.sum(dtype=np.uint64))
                high.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                marks.append(signer(s) if len(s) else s)
            if not size:
                continue
            offsets = np.cumsum([0] + [len(m) for m in marks]).astype(np.int32)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(offsets), as_long(np.concatenate(marks)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), as_long(low), as_long(high), listed], ["doc_id", "n_shingles", "low", "high", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, low long, high long, bands array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the full sets, eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for _, s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return docs.select(F.col("doc_id").alias("node"), "text").mapInArrow(run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b): those with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _bins_of(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) % np.uint64(_BINS)).astype(np.int64)


def rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` fall into each hashed bin: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_BINS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(counts, _bins_of(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bin", "n"])

    found = sets.select("shingles").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_BINS, np.int64)
    counts[found["bin"].to_numpy()] = found["n"].to_numpy()
    return counts


#: Rows of one shingle that meet each other in one task; more are dealt to a square of tiles.
TILE = 2048


def prefixes(sets: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """(node, n, place, shingle): of each set of n shingles, rarest first, those that a pair can have as its first in common.

    Of two sets with ``percent`` in common the smaller one has percent n / 100 shingles in common at least, so as
    many of it lie at or behind the place of the first one in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, places, found = [], [], [], []
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(x)
                long = n - -(-percent * n // 100) + 1
                rare = x[np.lexsort((x, counts[_bins_of(x)]))[:long]]
                nodes.append(np.full(long, node, np.int64))
                sizes.append(np.full(long, n, np.int64))
                places.append(np.arange(long))
                found.append(rare.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (nodes, sizes, places, found)], ["node", "n", "place", "shingle"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, n long, place long, shingle long")


def uncompared(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that may be alike, among members of buckets that hold several components; none that is alike is missing."""
    placed = checkpoint(buckets.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lowest"), F.max("label").alias("highest")).where("lowest < highest").select("bucket")
    left = checkpoint(placed.join(mixed, "bucket", "left_semi").select("node", "label").distinct())
    release(placed)
    theirs = checkpoint(sets.join(left.select("node"), "node", "left_semi"))
    rare = checkpoint(prefixes(theirs, percent, rarity(theirs)).join(left, "node"))
    release(theirs, left)
    held = rare.groupBy("shingle").agg(F.min("label").alias("lowest"), F.max("label").alias("highest"), F.count("*").alias("held"))
    across = held.where("lowest < highest").select("shingle", F.ceil(F.col("held") / TILE).cast("int").alias("tiles"))
    tiled = checkpoint(rare.join(across, "shingle"))
    release(rare)
    sweep(sets.sparkSession)
    # A row of a common shingle has one place on its own side of the square and meets all on the other.
    own, other = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    side = lambda x, tiles: tiled.select("shingle", *tiles, *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "place", "label")))
    # The smaller set shares 2 percent n / (100 + percent) shingles with one that is not smaller: its prefix is shorter.
    first = side("x", (own.alias("i"), other.alias("j"))).where(f"x_place < x_n - ceil({2 * percent} * x_n / {100 + percent}) + 1")
    fits = F.expr(f"""x_label <> y_label AND (x_n < y_n OR x_n = y_n AND x_node < y_node) AND 100 * x_n >= {percent} * y_n
      AND {100 + percent} * least(x_n - x_place, y_n - y_place) >= {percent} * (x_n + y_n)""")
    met = first.join(side("y", (other.alias("i"), own.alias("j"))), ["shingle", "i", "j"]).where(fits)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links of similarity
    percent / 100 or more between sets of distinct ``words``-word shingles; a text of
    fewer words is one shingle; without words (NULL, empty) a document is linked
    with nothing. ``kept`` marks the component's smallest id. Repeated rows keep
    one row each and the same component; a row without doc_id can't be named, so
    it comes back with a NULL component and ``kept``.
    An empty table gives no rows; texts are taken whole at any length. Other columns are ignored.
    """
    named = docs.select("doc_id", "text").where("doc_id is not null")
    signed = checkpoint(signatures(named, words, bands, rows))
    key = ["n_shingles", "low", "high"]
    classes = checkpoint(signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node")))
    nodes = signed.dropDuplicates(["doc_id"]).join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    every = checkpoint(nodes.select(F.col("doc_id").alias("node"), "n_shingles", F.posexplode("bands").alias("band", "bucket")))
    # Only buckets of two or more can link anything.
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    common = checkpoint(every.join(shared, "bucket"))
    # The text that copies were made from meets more of them than they meet each other: it is the best centre.
    met = common.groupBy("node").agg(F.sum("n").alias("met"))
    buckets = checkpoint(common.drop("n").join(met, "node"))
    release(every, common)
    sets = checkpoint(sets_of(named.dropDuplicates(["doc_id"]).join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), words))
    centres = buckets.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("o"), F.col("node").alias("centre"), F.col("n_shingles").alias("size"))).alias("c")).select("bucket", "c.centre", "c.size")
    star = buckets.join(centres, "bucket").where((F.col("node") != F.col("centre")) & (100 * F.least("n_shingles", "size") >= percent * F.greatest("n_shingles", "size")))
    pairs = checkpoint(star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    judged = checkpoint(confirmed(pairs, sets, percent))
    links = judged.where("linked").select("a", "b")
    labels = components(links)
    sweep(docs.sparkSession)
    # A star compares a bucket's members with one centre only; the others among them may be alike.
    rest = checkpoint(uncompared(buckets, labels, sets, percent).join(judged.select("a", "b"), ["a", "b"], "left_anti"))
    late = checkpoint(confirmed(rest, sets, percent))
    new = late.where("linked").select("a", "b")
    if not new.isEmpty():
        before, labels = labels, components(links.unionByName(new))
        release(before)
    release(buckets, sets, pairs, judged, rest, late)
    sweep(docs.sparkSession)
    labels = labels.withColumnRenamed("label", "component")
    classed = checkpoint(classes.join(labels, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id")))
    found = signed.select("doc_id", *key).join(classed, key, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    unnamed = signatures(docs.where("doc_id is null"), words, bands, rows).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(unnamed)
