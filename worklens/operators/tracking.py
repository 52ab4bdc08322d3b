"""Seen and saved postings, and the run-level records around them.

Snapshots are immutable: an upsert returns the next snapshot, which the caller
writes. Batches are reduced to one row per url by partial aggregation before
they meet a snapshot, so a url that fills a third of a batch sends one row per
task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.base import DAY, filled, strip, text, within
from ..session import checkpoint

SEEN_SCHEMA = (
    "url string, title string, company string, source string, first_seen double, last_seen double, seen_count bigint"
)
SAVED_COLUMNS = [
    "title", "company", "url", "source", "salary", "salary_int", "apply_url", "workplace_type", "company_url",
    "listed_epoch",
]
SAVED_SCHEMA = (
    "url string, title string, company string, source string, salary string, salary_int int, apply_url string, workplace_type string, "
    "company_url string, listed_epoch bigint, status string, saved_at double, applied_at double, notes string"
)


def with_seen(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Add ``is_seen``. Rows without a url are always new."""
    known = seen.select(F.col("url").alias("_url"), F.lit(True).alias("_known"))
    joined = postings.withColumn("_url", _spread(postings, strip(text(F.col("url"))))).join(known, "_url", "left")
    return joined.withColumn("is_seen", F.coalesce("_known", F.lit(False))).drop("_known", "_url")


def _spread(df: DataFrame, key: Column) -> Column:
    """``key``, or where it is empty a value that meets no other row and spreads over all tasks."""
    plain = [c for c, kind in df.dtypes if kind in ("string", "bigint", "int")]
    return F.when(key != "", key).otherwise(F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string")))


def sightings(batch: DataFrame, order: str = "posting_id") -> DataFrame:
    """One row per url of a batch: first and last time, number of rows, texts of the first row."""
    first = F.struct(
        "title", "company", "source"
    )
    keyed = batch.withColumn("url", strip(text(F.col("url")))).filter(F.col("url") != "")
    out = keyed.groupBy("url").agg(
        F.min_by(first, F.struct("seen_at", order)).alias("f"), F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("seen_count"),
    )
    return out.select("url", "f.title", "f.company", "f.source", "first_seen", "last_seen", "seen_count")


def upsert_seen(seen: DataFrame, batch: DataFrame, order: str = "posting_id") -> DataFrame:
    """Next snapshot, with ``is_new`` on the urls this batch inserted."""
    s, b = seen.alias("s"), sightings(batch, order).alias("b")
    both = s.join(b, "url", "full_outer")
    old = F.col("s.first_seen").isNotNull()
    keep = lambda n: F.when(old, F.col(f"s.{n}")).otherwise(F.col(f"b.{n}")).alias(n)
    return both.select(
        "url", keep("title"), keep("company"), keep("source"), keep("first_seen"),
        F.coalesce("b.last_seen", "s.last_seen").alias("last_seen"),
        (F.coalesce("s.seen_count", F.lit(0)) + F.coalesce("b.seen_count", F.lit(0))).alias("seen_count"),
        (~old).alias("is_new"),
    )


def saved_entry(postings: DataFrame) -> DataFrame:
    return postings.select(*SAVED_COLUMNS)


def upsert_saved(saved: DataFrame, batch: DataFrame, at: str = "saved_at", order: str = "posting_id") -> DataFrame:
    """Save postings: new urls get status 'saved'; known ones refresh their texts and keep the rest.

    Within a batch the last save of a url gives the texts and the first one the time.
    """
    fresh = [c for c in SAVED_COLUMNS if c != "url"]
    latest = batch.groupBy("url").agg(
        F.max_by(F.struct(*fresh), F.struct(at, order)).alias("n"), F.min(at).alias("_at")
    )
    both = saved.alias("s").join(latest.alias("b"), "url", "full_outer")
    hit, old = F.col("b.n").isNotNull(), F.col("s.status").isNotNull()
    return both.select(
        "url", *[F.when(hit, F.col(f"b.n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in fresh],
        F.coalesce("s.status", F.lit("saved")).alias("status"),
        F.when(old, F.col("s.saved_at")).otherwise(F.col("b._at")).alias("saved_at"),
        F.col("s.applied_at").alias("applied_at"),
        F.when(old, F.col("s.notes")).otherwise("").alias("notes"),
    )


def change_status(saved: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (url, status, at, seq) changes: unknown statuses are ignored, the latest one counts,
    and the latest 'applied' stamps ``applied_at``. Urls that were never saved stay unsaved."""
    valid = changes.filter(within(F.col("status"), fixed.SAVED_STATUSES))
    last = valid.groupBy("url").agg(
        F.max_by("status", F.struct("at", "seq")).alias("_status"),
        F.max(F.when(F.col("status") == "applied", F.col("at"))).alias("_applied"),
    )
    out = saved.join(last, "url", "left")
    return out.withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "applied_at": F.coalesce("_applied", "applied_at"),
        }
    ).drop("_status", "_applied")


def saved_view(saved: DataFrame) -> DataFrame:
    return saved.filter(F.col("status") != "dismissed").select(*SAVED_COLUMNS)


def with_saved(postings: DataFrame, saved: DataFrame) -> DataFrame:
    """Add ``is_saved``: the url is in the saved table and not dismissed."""
    live = saved.filter(F.col("status") != "dismissed").select(F.col("url").alias("_url"), F.lit(True).alias("_saved"))
    joined = postings.withColumn("_url", _spread(postings, text(F.col("url")))).join(live, "_url", "left")
    return joined.withColumn("is_saved", F.coalesce("_saved", F.lit(False))).drop("_saved", "_url")


def salary_cell(salary: Column, salary_int: Column) -> Column:
    shown = filled(strip(text(salary)))
    return F.coalesce(
        shown,
        F.when(salary_int > 0, F.concat(salary_int.cast("string"), F.lit(" LPA"))),
        F.lit(""),
    )


def posted_cell(epoch: Column, as_of: Column) -> Column:
    days = F.floor((as_of.cast("double") - epoch) / DAY)
    return (
        F.when(F.coalesce(epoch, F.lit(0)) == 0, "").when(days <= 0, "today")
        .otherwise(F.concat(days.cast("string"), F.lit("d")))
    )


# --- scorer cache -------------------------------------------------------------


def cache_key(task: Column, *inputs: Column) -> Column:
    """Content key: SHA-256 over the task and the JSON form of every input, zero bytes between."""
    parts = [task] + [F.to_json(F.struct(i.alias("v"))) for i in inputs]
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def cache_put(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """Latest value per (task, key) over the cache and the writes."""
    both = cache.unionByName(writes)
    return both.groupBy("task", "key").agg(
        F.max_by("value", "created").alias("value"), F.max("created").alias("created")
    )


def cache_get(wanted: DataFrame, cache: DataFrame, ttl: int, as_of: Column) -> DataFrame:
    """Add ``value``: NULL on a miss. A lifetime of zero makes every read a miss."""
    fresh = cache.filter(F.lit(ttl > 0) & (as_of.cast("double") - F.col("created") <= ttl))
    return wanted.join(fresh.select("task", "key", "value"), ["task", "key"], "left")


def cache_prune(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.filter(F.col("created") >= as_of.cast("double") - fixed.CACHE_MAX_AGE)


def work_list(ranked: DataFrame, cache: DataFrame, ttl: int, max_calls: int, by: list[str], as_of: Column) -> DataFrame:
    """Rows to score: cache hits are free, then at most ``max_calls`` misses per group in rank order."""
    from .rank import first_n

    looked = checkpoint(cache_get(ranked, cache, ttl, as_of))  # hits and misses read the ranked input once
    hits = looked.filter(F.col("value").isNotNull()).withColumn("call_no", F.lit(None).cast("int"))
    misses = looked.filter(F.col("value").isNull())
    if max_calls > 0:
        misses = first_n(misses, max_calls, by, [F.asc("rank")], "call_no")
    else:
        misses = misses.withColumn("call_no", F.lit(None).cast("int"))
    return hits.unionByName(misses)
