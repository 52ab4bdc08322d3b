"""Streaming forms: score a stream, watch for new postings, keep seen counts.

Row-wise steps run on the stream as they are. State that only grows by sums
and extremes is a native streaming aggregation, kept incrementally in the
state store. Steps that join a snapshot run per micro-batch and write under
the batch number, so a batch that is run again overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.base import strip, text
from ..operators import tracking
from ..operators.filters import FilterOptions, Profile
from ..plans import search
from ..session import checkpoint


def now() -> Column:
    """Time of the micro-batch in epoch seconds."""
    return F.unix_timestamp(F.current_timestamp()).cast("double")


def scored_stream(postings: DataFrame, profile: Profile, options: FilterOptions, as_of: Column | None = None) -> DataFrame:
    """Kept postings of a stream with score and reasons: no state, no shuffle."""
    return search.scored(postings, profile, options, now() if as_of is None else as_of)


def seen_counts(sightings: DataFrame) -> DataFrame:
    """Running seen table of a stream of sightings (url, title, company, source, seen_at, posting_id).

    A native aggregation: its state per url is one row, and rows of one url are
    combined inside each task first.
    """
    keyed = sightings.withColumn("url", strip(text(F.col("url")))).filter(F.col("url") != "")
    first = F.struct("title", "company", "source")
    return keyed.groupBy("url").agg(
        F.min_by(first, F.struct("seen_at", "posting_id")).alias("first_row"), F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("seen_count"),
    )


#: Parts of the seen table; a batch touches those of its urls.
BUCKETS = 64


def seen_now(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The seen table of a watch folder after batch ``number``."""
    versions = spark.read.parquet(f"{folder}/current/batch={number}").collect()
    paths = [f"{folder}/seen/version={r.version}/bucket={r.bucket}" for r in versions]
    return spark.read.schema(tracking.SEEN_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], tracking.SEEN_SCHEMA)


def watch(
    postings: DataFrame, profile: Profile, options: FilterOptions, folder: str, checkpoint_at: str,
    as_of: Column | None = None, mark: bool = True, initial: DataFrame | None = None,
) -> StreamingQuery:
    """Emit only postings whose url was not seen before, then mark all ranked ones.

    The seen table lies in BUCKETS by hash of the url. A batch reads and writes
    only the buckets of its own urls, under its number; ``current`` lists the last
    number of each bucket. So the cost of a batch follows its urls, not the history,
    and a batch that runs again writes the same files (with ``as_of`` given or taken
    from a column of the rows, not from the clock).
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        time = now() if as_of is None else as_of
        rows = checkpoint(search.scored(batch, profile, options, time).withColumn("seen_at", time))
        own = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(strip(text(F.col("url")))), F.lit(BUCKETS)).cast("int"))
        versions = {r.bucket: r.version for r in spark.read.parquet(f"{folder}/current/batch={number - 1}").collect()} if number else {}
        touched = {r.bucket for r in own(rows).select("bucket").distinct().collect()}  # at most BUCKETS numbers
        if number == 0 and initial is not None:
            seen, touched = initial, set(range(BUCKETS))
        else:
            paths = [f"{folder}/seen/version={versions[b]}/bucket={b}" for b in sorted(touched & versions.keys())]
            seen = spark.read.schema(tracking.SEEN_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], tracking.SEEN_SCHEMA)
        fresh = tracking.with_seen(rows, seen).filter(~F.col("is_seen")).drop("is_seen", "seen_at")
        fresh.write.mode("overwrite").parquet(f"{folder}/new/batch={number}")
        if mark or number == 0:
            after = tracking.upsert_seen(seen, rows).drop("is_new") if mark else seen
            target = f"{folder}/seen/version={number}"
            own(after).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
            versions |= {r.bucket: number for r in spark.read.parquet(target).select("bucket").distinct().collect()} if not after.isEmpty() else {}
        spark.createDataFrame(sorted(versions.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/current/batch={number}")

    return postings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_at).trigger(availableNow=True).start()
