"""Fuzzy duplicates against everything that earlier batches kept, through a persisted prefix index.

The index holds the kept postings' titles and companies under the keys by which similar
strings meet (rarest bigrams, words), and the postings by title and company, each in hash buckets. A batch reads
the buckets of its own keys, drops what a kept posting resembles, settles the rest among itself by the greedy
rule, and appends what it keeps. So batches in order of ``order`` keep what one pass over their union keeps,
and a batch's cost follows its own strings.

A batch is there once its marker is written; files of one that failed half-way are not read, and it can run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, similarity
from ..functions.base import text
from ..functions.words import match_key
from ..session import checkpoint, small
from . import dedup

#: Buckets of each table of the index.
BUCKETS = 256
_TABLES = {"titles": "key string, s string", "names": "key string, s string", "nodes": "t string, c string, id long"}


class KeptIndex:
    """The index under ``folder``; ``number`` counts the batches from 0."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _done(self) -> list[int]:
        """Numbers of the batches that ended."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path)) if files.exists(path) else []

    def _read(self, name: str, wanted: DataFrame, column: str, before: int) -> DataFrame:
        """Rows of a table in the buckets of ``wanted``'s keys: at most as many bucket numbers as there are buckets go through the driver."""
        batches = [n for n in self._done() if n < before]
        touched = [r[0] for r in wanted.select(self._bucket(F.col(column))).distinct().collect()]
        if not batches or not touched:
            return self.spark.createDataFrame([], _TABLES[name])
        whole = self.spark.read.schema(f"{_TABLES[name]}, batch int, bucket int").parquet(f"{self.folder}/{name}")
        return whole.where(F.col("batch").isin(batches) & F.col("bucket").isin(touched)).drop("batch", "bucket")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, name: str, rows: DataFrame, column: str, number: int) -> None:
        held = rows.withColumn("bucket", self._bucket(F.col(column)))
        held.repartition("bucket").sortWithinPartitions("bucket", column).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/batch={number}")

    def _order(self, name: str, strings: DataFrame, number: int) -> Column:
        """Counts of bigrams that put all batches' bigrams in one order: those of the first batch, by rule at most some 1500."""
        path = f"{self.folder}/order-{name}"
        if number == 0 or not self._done():
            flat = strings.filter(F.length("s") > 1).select(F.explode(similarity.bigrams(F.col("s"))).alias("g"))
            flat.groupBy("g").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(path)
        counts = {r["g"]: r["n"] for r in self.spark.read.schema("g string, n long").parquet(path).collect()}
        return F.expr("map(" + ", ".join(f"'{g}', {n}L" for g, n in sorted((counts or {"": 0}).items())) + ")")

    def keep(self, batch: DataFrame, number: int, title_at_least: float = fixed.TITLE_SIMILARITY, company_at_least: float = fixed.COMPANY_SIMILARITY, order: str = "posting_id") -> DataFrame:
        """Rows of ``batch`` that survive against all batches before ``number`` and against each other; they join the index."""
        keys = batch.select(
            F.col(order).alias("id"), similarity.sorted_words(match_key(F.col("title"))).alias("t"), similarity.sorted_words(match_key(F.col("company"))).alias("c")
        )
        nodes = checkpoint(keys.groupBy("t", "c").agg(F.min("id").alias("id")))
        titles, names = nodes.select(F.col("t").alias("s")).distinct(), nodes.select(F.col("c").alias("s")).distinct()
        title_keys = checkpoint(_title_keys(titles, self._order("titles", titles, number), title_at_least))
        marked = names.select(F.concat(F.lit("^"), F.replace("s", F.lit(" "), F.lit("^"))).alias("s"))
        name_keys = checkpoint(_name_keys(names, self._order("names", marked, number), company_at_least))
        by_title = self._similar("titles", title_keys.select("s", F.col("key").alias("sought")), similarity.plain_ratio, title_at_least, number)
        # What holds a word meets what is probed by it, either way round.
        sought = F.translate(F.substring("key", 1, 1), "wp", "pw")
        by_name = self._similar("names", name_keys.select("s", F.concat(sought, F.expr("substring(key, 2)")).alias("sought")), similarity.name_ratio, company_at_least, number)
        alike = nodes.join(by_title.toDF("t", "t2"), "t").join(by_name.toDF("c", "c2"), "c").select("id", F.col("t2").alias("t"), F.col("c2").alias("c"))
        alike = checkpoint(alike)
        stored = self._read("nodes", alike, "t", number)
        known = checkpoint(alike.join(stored.select("t", "c"), ["t", "c"], "left_semi").select("id").distinct())
        rest = checkpoint(nodes.join(small(known), "id", "left_anti"))
        own_titles = dedup.similar_titles(rest.select(F.col("t").alias("s")).distinct(), title_at_least)
        own_names = dedup.similar_names(rest.select(F.col("c").alias("s")).distinct(), company_at_least)
        removed = dedup.greedy_removed(dedup.similar_nodes(rest, [], own_titles, own_names))
        kept = checkpoint(rest if removed is None else rest.join(removed, "id", "left_anti"))
        for name, keys_ in (("titles", title_keys), ("names", name_keys)):
            column = "t" if name == "titles" else "c"
            self._write(name, keys_.join(kept.select(F.col(column).alias("s")).distinct(), "s", "left_semi").select("key", "s"), "key", number)
        self._write("nodes", kept.select("t", "c", "id"), "t", number)
        self._commit(number)
        return batch.join(kept.select(F.col("id").alias(order)), order, "left_semi")

    def _similar(self, name: str, asked: DataFrame, measure, threshold: float, number: int) -> DataFrame:
        """(s, s2): strings of the batch and kept ones that meet under a key and reach the ratio."""
        stored = self._read(name, asked, "sought", number)
        met = asked.join(stored.select(F.col("key").alias("sought"), F.col("s").alias("s2")), "sought")
        near = 200 * F.least(F.length("s"), F.length("s2")) >= (F.length("s") + F.length("s2")) * threshold if name == "titles" else F.lit(True)
        pairs = met.where(near).select("s", "s2").distinct()
        return checkpoint(pairs.where((F.col("s") == F.col("s2")) | (measure(F.col("s"), F.col("s2")) >= threshold)))

    def _commit(self, number: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done/{number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()


def _title_keys(titles: DataFrame, counts: Column, threshold: float) -> DataFrame:
    """(s, key): prefix bigrams of a title; one of up to two characters is its own key, since it matches only itself."""
    most = F.floor(F.length("s") * dedup._share(threshold)) + 1
    prefix = F.when(F.length("s") > 2, dedup._rare_first(dedup._numbered_bigrams(F.col("s")), counts, most)).otherwise(F.array(F.concat(F.lit("="), "s")))
    return titles.select("s", F.explode(prefix).alias("key"))


def _name_keys(names: DataFrame, counts: Column, threshold: float) -> DataFrame:
    """(s, key): g prefix bigrams, w all words, p words of just over 3/14 of the name's length; a missing name is its own key."""
    most = F.floor(F.length("s") * dedup._share(threshold)) + 1
    grams = F.transform(dedup._rare_first(dedup._word_bigrams(F.col("s")), counts, most), lambda g: F.concat(F.lit("g"), g))
    words = F.array_distinct(F.split("s", " "))
    # Longest words first: any choice of words of that length holds a common one, and few words are enough.
    by_length = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    passed = lambda i: F.aggregate(F.slice(by_length, F.lit(1), i), F.lit(0), lambda acc, w: acc + F.length(w))
    probe = F.filter(by_length, lambda w, i: (i == 0) | (passed(i) <= F.length("s") * 3.0 / 14.0))
    every = F.concat(grams, F.transform(words, lambda w: F.concat(F.lit("w"), w)), F.transform(probe, lambda w: F.concat(F.lit("p"), w)))
    return names.select("s", F.explode(F.when(F.col("s") == "", F.array(F.lit("="))).otherwise(every)).alias("key"))
