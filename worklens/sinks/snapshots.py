"""Snapshots in hash buckets: a batch reads and rewrites only the buckets of its own keys.

A bucket is one folder of Parquet files, sorted by key and with a Bloom filter of the keys, written
under the version that last changed it. A manifest per version lists every bucket with that version, its
rows and its smallest and largest key. Its appearance is the commit: files of a batch that failed before are
never read, and a batch that comes again after its commit changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Apply = Callable[[DataFrame, DataFrame], DataFrame]


class Entry(NamedTuple):
    """A bucket's line in the manifest."""

    bucket: int
    version: int
    rows: int
    low: str
    high: str


class Snapshot:
    """A table of one row per ``key`` under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "url", buckets: int = 256):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    # --- manifests ---

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, rising."""
        path, files = self._path("manifest")
        found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(name) for name in found if name.isdigit())

    def entries(self, version: int | None = None) -> dict[int, Entry]:
        """Buckets of a version, of the last one by default."""
        known = self.versions()
        if not known:
            return {}
        path, _ = self._path("manifest", str(known[-1] if version is None else version))
        lines = self.spark.read.text(path.toString()).collect()  # a line per bucket
        return {e.bucket: e for e in (Entry(*json.loads(r.value)) for r in lines)}

    def _commit(self, version: int, entries: Iterable[Entry]) -> None:
        """Write the manifest beside its place and move it there: it appears whole or not at all."""
        beside, files = self._path("manifest", f"{version}.new")
        out = files.create(beside, True)
        out.write(bytearray("".join(json.dumps(list(e)) + "\n" for e in sorted(entries)).encode()))
        out.close()
        there, _ = self._path("manifest", str(version))
        if not files.rename(beside, there):
            raise RuntimeError(f"version {version} of {self.folder} is there already")

    # --- reading ---

    def _rows(self, entries: Iterable[Entry]) -> DataFrame:
        paths = [f"{self.folder}/data/version={e.version}/bucket={e.bucket}" for e in entries]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.entries(version).values())

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _touched(self, keys: DataFrame) -> dict[int, tuple[str, str]]:
        """Buckets of ``keys`` with the smallest and largest key in each: as many rows as buckets at most."""
        ranges = self._bucketed(keys.select(self.key)).groupBy("bucket").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"))
        return {r.bucket: (r.low, r.high) for r in ranges.collect()}

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys``, from the buckets whose range of keys may hold them; Bloom filters spare row groups."""
        wanted = self._touched(keys)
        near = [e for b, e in self.entries().items() if b in wanted and e.low <= wanted[b][1] and wanted[b][0] <= e.high]
        return self._rows(near).join(keys.select(self.key).distinct(), self.key, "left_semi")

    # --- writing ---

    def merge(self, number: int, batch: DataFrame, apply: Apply, keys: DataFrame | None = None) -> list[int]:
        """Version ``number``: ``apply(old rows, batch)`` for the buckets of the batch's keys (``keys``, if the batch itself has other ones); the others stay. Gives the buckets it rewrote.

        ``batch`` must hold each key as the table does. Rows without a key are not kept.
        """
        known = self.versions()
        if known and number <= known[-1]:
            return []
        before = self.entries()
        touched = self._touched((batch if keys is None else keys).where(F.col(self.key).isNotNull()))
        target = f"{self.folder}/data/version={number}"
        after = apply(self._rows(before[b] for b in sorted(touched) if b in before), batch.where(F.col(self.key).isNotNull()))
        fields = self.spark.createDataFrame([], self.schema).schema
        held = self._bucketed(after.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]))
        held = held.where(F.col("bucket").isin(list(touched))).repartition("bucket").sortWithinPartitions("bucket", self.key)
        writer = held.write.mode("overwrite").partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        writer.parquet(target)
        written = []
        if touched:
            of = self.spark.read.schema(f"{self.schema}, bucket int").parquet(target).groupBy("bucket")
            written = [Entry(r.bucket, number, r.rows, r.low, r.high) for r in of.agg(F.count(F.lit(1)).alias("rows"), F.min(self.key).alias("low"), F.max(self.key).alias("high")).collect()]
        self._commit(number, [*(e for b, e in before.items() if b not in touched), *written])
        return sorted(touched)

    def vacuum(self, versions: int = 1) -> int:
        """Delete the buckets that none of the last ``versions`` manifests names, and older manifests; gives how many folders went."""
        known = self.versions()
        needed = {(e.version, b) for v in known[-versions:] for b, e in self.entries(v).items()}
        path, files = self._path("data")
        gone = 0
        for version in files.listStatus(path) if files.exists(path) else []:
            n = int(version.getPath().getName().split("=")[1])
            if n > known[-1]:
                continue  # a batch at work
            for bucket in files.listStatus(version.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("bucket=") and (n, int(name.split("=")[1])) not in needed:
                    files.delete(bucket.getPath(), True)
                    gone += 1
        for v in known[:-versions]:
            files.delete(self._path("manifest", str(v))[0], False)
        return gone
