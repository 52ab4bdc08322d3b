"""Queries that replay a table as a stream of several batches; each equals its batch form in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rank
from ..session import shared_folder
from ..sinks import committed, documents
from ..sources import landing, payloads
from ..streaming import arrivals, breaker, watch
from . import shapes, sourcing
from .ranking import CANDIDATE, OPTIONS, SCORED
from .registry import ORACLE, query
from .shapes import as_of, table, with_
from .tracking import LATE, RUNS, SIGHTINGS, sightings, source_runs

PARTS = 4


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"


def replayed(rows: DataFrame, order: str, folder: str) -> DataFrame:
    """A stream of PARTS batches of ``rows``. Each file holds a range of ``order``; there are as many as a shuffle has parts, so no task holds a batch."""
    spark = rows.sparkSession
    per_batch = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTS)
    rows.repartitionByRange(PARTS * per_batch, order).sortWithinPartitions(order).write.option("maxRecordsPerFile", 0).parquet(f"{folder}/in")
    per_batch = -(-len(spark.read.schema(rows.schema).parquet(f"{folder}/in").inputFiles()) // PARTS)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, per_batch)).parquet(f"{folder}/in")


@query(
    "seen_stream",
    with_(SIGHTINGS, body="""SELECT url, first(title ORDER BY seen_at, posting_id) AS title, first(company ORDER BY seen_at, posting_id) AS company,
      first(source ORDER BY seen_at, posting_id) AS source, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS seen_count
      FROM sightings WHERE url <> '' GROUP BY url"""),
)
def seen_stream(spark, sf_dir):
    """The running seen table after all batches, from the state store."""
    folder = _folder(spark)
    stream = replayed(sightings(spark, sf_dir).drop("ts"), "posting_id", folder)
    counts = watch.seen_counts(stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    writer = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select("url", "first_row.*", "first_seen", "last_seen", "seen_count")


def _parted(rows: DataFrame, part: Column, folder: str) -> Callable[[int], DataFrame]:
    """Write ``rows`` once, by part, and give a reader of one part: it opens the files of that part alone."""
    numbered = rows.withColumn("_part", part)
    numbered.write.partitionBy("_part").parquet(f"{folder}/parts")
    back = rows.sparkSession.read.schema(numbered.schema).parquet(f"{folder}/parts")
    return lambda number: back.where(F.col("_part") == number).drop("_part")


def _in_parts(rows: DataFrame, part: Column, folder: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Land ``rows`` in PARTS parts by number; after each, the stream starts from its checkpoint, takes what is new and ends.

    So the order of the batches follows the data, not the times of files.
    """
    spark = rows.sparkSession
    one = _parted(rows, part, folder)
    for number in range(PARTS):
        one(number).write.parquet(f"{folder}/in/landed={number}")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/landed=*")).awaitTermination()


#: Runs land up to so many seconds after the next part's, and the watermark waits twice as long.
DISORDER = 3600


def _breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the breaker over a stream of runs that is out of order by up to DISORDER seconds."""
    folder = _folder(spark)
    rows = source_runs(spark, sf_dir).drop("errors")
    landed = F.col("ts") + F.pmod(F.xxhash64("run_id"), F.lit(DISORDER))
    low, high = rows.agg(F.min(landed), F.max(landed)).first()
    width = ((high or 0) - (low or 0)) / PARTS + 1

    def run(stream: DataFrame) -> StreamingQuery:
        changes = breaker.breaker_changes(stream, f"{2 * DISORDER} seconds")
        with breaker.keyed_state(spark):
            return changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

    _in_parts(rows, F.floor((landed - (low or 0)) / width).cast("int"), folder, run)
    return spark.read.schema(breaker.CHANGES).parquet(f"{folder}/out")


@query("breaker_stream", with_(RUNS, body=f"SELECT source, ok_streak, fail_streak, last_ok, cooldown_until, cooldown_until > {LATE} AS is_open FROM state"))
def breaker_stream(spark, sf_dir):
    """Breaker state after a stream of runs that come out of order."""
    return breaker.latest_state(_breaker(spark, sf_dir)).withColumn("is_open", F.col("cooldown_until") > LATE)


@query(
    "breaker_changes",
    with_(RUNS, body=f"""SELECT source, change, "at" FROM (
      SELECT source, ts, unnest(list_filter([
          CASE WHEN ok AND before_open AND before_until > ts THEN {{'change': 'closed', 'at': ts}} END,
          CASE WHEN before_open AND before_until <= ts THEN {{'change': 'closed', 'at': before_until}} END,
          CASE WHEN opens AND NOT (before_open AND before_until > ts) THEN {{'change': 'opened', 'at': ts}} END,
          CASE WHEN next_ts IS NULL AND opens AND ts + 1800 <= mark THEN {{'change': 'closed', 'at': ts + 1800}} END], lambda x: x IS NOT NULL), recursive := true)
      FROM (SELECT *, lag(opens, 1, false) OVER v AS before_open, lag(ts, 1, 0.0) OVER v + 1800 AS before_until, lead(ts) OVER v AS next_ts
        FROM (SELECT *, NOT ok AND fail_no >= 3 AS opens, (SELECT max(ts) FROM source_runs) - {2 * DISORDER} AS mark FROM streaks) WHERE ts <= mark
        WINDOW v AS (PARTITION BY source ORDER BY ts, run_id)))"""),
)
def breaker_changes(spark, sf_dir):
    """When sources were opened and closed, by a success or by the end of their cooldown, up to the watermark."""
    return _breaker(spark, sf_dir).where("change <> 'state'").select("source", "change", "at")


@query(
    "watch_stream",
    with_(SCORED, body="""SELECT min(posting_id) AS posting_id, url, count(*) AS n FROM scored WHERE url <> '' GROUP BY url"""),
)
def watch_stream(spark, sf_dir):
    """First sighting of every url of a watched stream of postings, and how often it was seen."""
    folder = _folder(spark)
    rows = shapes.postings(spark, sf_dir)
    most = rows.agg(F.max("posting_id")).first()[0] or 0
    part = F.floor(F.col("posting_id") * PARTS / (most + 1)).cast("int")
    # A part is a range of numbers, which few files hold; spread, every task of a batch has postings to score.
    _in_parts(shapes.spread(rows, "posting_id"), part, folder, lambda stream: watch.watch(stream, CANDIDATE, OPTIONS, f"{folder}/out", f"{folder}/state", as_of()))
    number = max(r.batch for r in spark.read.parquet(f"{folder}/out/current").select("batch").distinct().collect())
    seen = watch.seen_now(spark, f"{folder}/out", number).select("url", F.col("seen_count").alias("n"))
    new = spark.read.option("mergeSchema", "true").parquet(f"{folder}/out/new").filter(F.col("url") != "")
    return new.groupBy("url").agg(F.min("posting_id").alias("posting_id")).join(seen, "url").select("posting_id", "url", "n")


def _arrivals(spark, sf_dir):
    """Events as batches of hourly runs, landing in order of time; the watermark waits ten minutes."""
    at, folder = F.col("ts").cast("timestamp"), _folder(spark)
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.unix_timestamp(F.date_trunc("hour", at)) / 3600).alias("run_id"), F.col("event_id").alias("batch_id"), (F.col("user_id") % 8).cast("string").alias("source"),
        F.unix_timestamp(F.date_trunc("hour", at)).cast("double").alias("started_at"), (F.unix_micros(at) / 1000000).alias("arrived_at"),
    )
    low, high = rows.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    width = ((high or 0) - (low or 0)) / PARTS + 1

    def run(stream: DataFrame) -> StreamingQuery:
        found = arrivals.arrivals(stream, "600 seconds")
        with breaker.keyed_state(spark):
            return found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

    _in_parts(rows, F.floor((F.col("arrived_at") - (low or 0)) / width).cast("int"), folder, run)
    return spark.read.schema(arrivals.ARRIVALS).parquet(f"{folder}/out")


@query("arrived_in_time_stream", ORACLE["arrived_in_time"])
def arrived_in_time_stream(spark, sf_dir):
    """Batches of a stream that arrived inside their run's budget."""
    return _arrivals(spark, sf_dir).where("kind = 'used'").select(F.col("batch_id").alias("event_id"))


@query(
    "closed_runs",
    """SELECT run_id, count(*) AS n_used, count(DISTINCT source) AS n_sources FROM (
        SELECT epoch(date_trunc('hour', ts))::BIGINT // 3600 AS run_id, user_id % 8 AS source, epoch(ts) AS arrived, epoch(date_trunc('hour', ts)) AS started, max(epoch(ts)) OVER () AS latest FROM events)
      WHERE arrived <= started + 120 AND started + 120 <= latest - 600 GROUP BY run_id""",
)
def closed_runs(spark, sf_dir):
    """Runs whose budget ended before the watermark, with what they used."""
    return _arrivals(spark, sf_dir).where("kind = 'closed'").select("run_id", "n_used", "n_sources")


@query(
    "committed_documents",
    with_(shapes.POSTINGS, body="""SELECT posting_id % 4 AS run_id, row_number() OVER (PARTITION BY posting_id % 4 ORDER BY posting_id) AS rank, posting_id, title,
      count(*) OVER (PARTITION BY posting_id % 4) AS found_count FROM postings"""),
)
def committed_documents(spark, sf_dir):
    """Headers and lines of runs that a stream published together, read back."""
    folder = _folder(spark)
    rows = shapes.postings(spark, sf_dir).select((F.col("posting_id") % PARTS).alias("run_id"), "posting_id", "title", (-F.col("posting_id")).cast("double").alias("score"), F.array().cast("array<string>").alias("reasons"))
    ranked = rank.full_rank(rows.drop("title", "reasons"), ["run_id"]).select("posting_id", "rank").join(rows, "posting_id")
    head = documents.header(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("found_count")))
    committed.register(spark)

    def run(stream: DataFrame) -> StreamingQuery:
        out = stream.writeStream.format("committed_rows").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        return out.trigger(availableNow=True).start()

    _in_parts(documents.parts(head, documents.job_lines(ranked, ["posting_id", "title"])), F.col("run_id"), folder, run)
    back = committed.read(spark, f"{folder}/out", "run_id long, rank long, body string")
    found = back.where("rank = 0").select("run_id", F.from_json("body", "found_count long")["found_count"].alias("found_count"))
    job = F.from_json("body", "posting_id long, title string")
    return back.where("rank > 0").select("run_id", "rank", job.alias("j")).join(found, "run_id").select("run_id", "rank", "j.posting_id", "j.title", "found_count")


@query("scored_stream", with_(SCORED, body="SELECT posting_id, score, array_to_string(reasons, '; ') AS reasons FROM scored"))
def scored_stream(spark, sf_dir):
    """Kept postings of a stream with score and reasons."""
    folder = _folder(spark)
    stream = replayed(shapes.postings(spark, sf_dir), "posting_id", folder)
    scored = watch.scored_stream(stream, CANDIDATE, OPTIONS, as_of()).select("posting_id", "score", F.array_join("reasons", "; ").alias("reasons"))
    writer = scored.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(
    "document_sources",
    """WITH r AS (SELECT user_id % 5 AS run_id, (user_id % 8)::VARCHAR AS source, event_type, event_id FROM events)
      SELECT run_id, n.c AS counts, COALESCE(e.c, '') AS errors FROM
        (SELECT run_id, string_agg(source || '=' || n, ',' ORDER BY source) AS c FROM (SELECT run_id, source, count(*) AS n FROM r GROUP BY ALL) GROUP BY run_id) n
      LEFT JOIN (SELECT run_id, string_agg(source || '=' || m, ',' ORDER BY source) AS c FROM (SELECT run_id, source, string_agg(DISTINCT x, ';' ORDER BY x) AS m
        FROM (SELECT *, 'HTTP ' || (event_id % 3 + 500) AS x FROM r WHERE event_type = 'error') GROUP BY ALL) GROUP BY run_id) e USING (run_id)""",
)
def document_sources(spark, sf_dir):
    """Counts and errors by source of every run's document header."""
    r = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("run_id"), (F.col("user_id") % 8).cast("string").alias("source"), "event_type", "event_id")
    errors = r.filter("event_type = 'error'").select("run_id", "source", F.concat(F.lit("HTTP "), (F.col("event_id") % 3 + 500).cast("string")).alias("error"))
    counts = r.groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    head = documents.header(documents.with_sources(r.select("run_id").distinct(), counts, errors))
    written = lambda c, value: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ",")
    return head.select(
        "run_id", written("source_counts", lambda v: v.cast("string")).alias("counts"), written("source_errors", lambda v: F.array_join(v, ";")).alias("errors")
    )


def _landed(rows: DataFrame, part: Column, schema: str, parse: Callable[[DataFrame], DataFrame], broken: str = "") -> DataFrame:
    """``parse`` over the records of ``rows``, written as JSON lines in PARTS landings; after each the stream goes on from its checkpoint.

    ``broken`` is put before every line of which the records are to be unreadable (none if empty).
    """
    spark = rows.sparkSession
    folder = _folder(spark)
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "_broken"]))
    line = F.when(F.col("_broken"), F.concat(F.lit(broken), line)).otherwise(line) if broken else line
    keyed = rows.select(part.cast("int").alias("_number"), line.alias("value"))
    one = _parted(keyed, F.col("_number"), folder)
    for number in range(PARTS):
        one(number).select("value").write.text(f"{folder}/in/{number:012d}")
        parsed = parse(landing.records(landing.lines(spark, f"{folder}/in"), schema))
        writer = parsed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parsed.schema).parquet(f"{folder}/out")


_FEED = "run_id long, feed_no long, payload string"


@query("landed_feed_rows", ORACLE["feed_rows"])
def landed_feed_rows(spark, sf_dir):
    """Matching entries of feeds that land one after another."""
    feeds = sourcing.feed_payloads(spark, sf_dir)
    return _landed(feeds, F.pmod("run_id", F.lit(PARTS)), _FEED, lambda r: payloads.feed(r, F.lit("small economy"), F.lit("Pune")))


@query("landed_feed_errors", ORACLE["feed_errors"])
def landed_feed_errors(spark, sf_dir):
    """Feeds among the landed ones that could not be read."""
    return _landed(sourcing.feed_payloads(spark, sf_dir), F.pmod("feed_no", F.lit(PARTS)), _FEED, payloads.feed_errors)


@query("landed_envelope_rows", ORACLE["nested_envelope_rows"])
def landed_envelope_rows(spark, sf_dir):
    """Hits of search envelopes that land one after another."""
    parse = lambda r: payloads.semantic_results(r.select("k", "payload")).select("k", "title", "url", "publishedDate", "author", "text", "score")
    return _landed(sourcing.envelopes(spark, sf_dir), F.pmod("k", F.lit(PARTS)), "k long, payload string", parse)


@query(
    "landed_corrupt_lines",
    """SELECT lpad((p_partkey % 4)::VARCHAR, 12, '0') AS landed, count(*) AS n, 'unreadable record' AS error FROM part WHERE p_partkey % 10 = 3 GROUP BY ALL""",
)
def landed_corrupt_lines(spark, sf_dir):
    """Lines of each landing that are no records; every tenth is cut here."""
    rows = sourcing.envelopes(spark, sf_dir).withColumn("_broken", F.col("k") % 10 == 3)
    found = _landed(rows, F.pmod("k", F.lit(PARTS)), "k long, payload string", landing.corrupt, broken='{"k": 7, "payload": ')
    return found.groupBy("landed", "error").agg(F.count(F.lit(1)).alias("n"))
