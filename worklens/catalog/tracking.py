"""Queries of the seen and saved tables, the scorer cache, source runs and the circuit breaker."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import runs, tracking
from ..session import shared_folder
from ..sinks import documents
from ..sinks.snapshots import Snapshot
from . import shapes
from .ranking import SCORED, scored
from .registry import ORACLE, query
from .shapes import AS_OF, POSTINGS, as_of, pick, sql_list, sql_pick, table, with_

SPLIT = "2024-01-16 00:00:00"


def sightings(spark, sf_dir):
    """One sighting per event; every seventh has no url."""
    url = F.concat(F.lit("https://x/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("posting_id"), F.when(F.col("event_id") % 7 == 0, " ").otherwise(url).alias("url"),
        F.col("event_type").alias("title"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("company"),
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("source"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double").alias("seen_at"),
        F.col("ts"),
    )


def history(spark, sf_dir):
    return tracking.sightings(sightings(spark, sf_dir).filter(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")))


def batch(spark, sf_dir):
    return sightings(spark, sf_dir).filter(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")).drop("ts")


SIGHTINGS = f"""
sightings AS (SELECT event_id AS posting_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'https://x/' || user_id || '/' || event_type END AS url,
  event_type AS title, 'c' || (user_id % 5) AS company, 's' || (event_id % 3) AS source, floor(epoch(ts))::DOUBLE AS seen_at,
  ts < TIMESTAMP '{SPLIT}' AS old FROM events),
seen AS (SELECT url, first(title ORDER BY seen_at, posting_id) AS title, first(company ORDER BY seen_at, posting_id) AS company,
  first(source ORDER BY seen_at, posting_id) AS source, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS seen_count
  FROM sightings WHERE old AND url <> '' GROUP BY url)"""


@query(
    "new_or_seen",
    with_(SIGHTINGS, body="""SELECT posting_id, url <> '' AND url IN (SELECT url FROM seen) AS is_seen
      FROM sightings WHERE NOT old"""),
)
def new_or_seen(spark, sf_dir):
    return tracking.with_seen(batch(spark, sf_dir), history(spark, sf_dir)).select("posting_id", "is_seen")


_UPSERT = """merged AS (SELECT url, first(title ORDER BY seen_at, posting_id) AS title,
  first(company ORDER BY seen_at, posting_id) AS company, first(source ORDER BY seen_at, posting_id) AS source,
  min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS seen_count, NOT bool_or(old) AS is_new
  FROM sightings WHERE url <> '' GROUP BY url)"""


@query("seen_upsert", with_(SIGHTINGS, _UPSERT, body="SELECT * FROM merged"))
def seen_upsert(spark, sf_dir):
    return tracking.upsert_seen(history(spark, sf_dir), batch(spark, sf_dir))


@query(
    "seen_totals",
    with_(SIGHTINGS, _UPSERT, body="""SELECT count(*) AS seen_urls_total, count(*) FILTER (is_new) AS marked_seen FROM merged"""),
)
def seen_totals(spark, sf_dir):
    return tracking.upsert_seen(history(spark, sf_dir), batch(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("seen_urls_total"), F.count_if("is_new").alias("marked_seen")
    )


@query(
    "visible_rows",
    with_(SIGHTINGS, body="""SELECT posting_id FROM sightings WHERE NOT old AND NOT (url <> '' AND url IN (SELECT url FROM seen))"""),
)
def visible_rows(spark, sf_dir):
    """Rows shown by default: the seen ones are hidden."""
    return tracking.with_seen(batch(spark, sf_dir), history(spark, sf_dir)).filter(~F.col("is_seen")).select("posting_id")


# --- saved table ---------------------------------------------------------------

STATUS_OF = {"O": "saved", "F": "applied", "P": "dismissed"}


def saved(spark, sf_dir):
    k = F.col("o_orderkey")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    status = F.when(F.col("o_orderstatus") == "O", "saved").when(F.col("o_orderstatus") == "F", "applied").otherwise("dismissed")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("url"), F.concat(F.lit("t"), (k % 11).cast("string")).alias("title"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("company"), F.lit("board").alias("source"),
        pick(shapes.SALARIES, k).alias("salary"),
        F.when(k % 3 > 0, (F.col("o_totalprice") / 10000).cast("int")).alias("salary_int"),
        F.lit("").alias("apply_url"), pick(shapes.WORKPLACES, k).alias("workplace_type"), F.lit("").alias("company_url"),
        F.when(k % 4 > 0, F.lit(AS_OF) - (k % 40) * 43200).alias("listed_epoch"),
        status.alias("status"), at.alias("saved_at"),
        F.when(status == "applied", at + 60).alias("applied_at"), F.lit("").alias("notes"),
    )


SAVED = f"""
saved AS (SELECT o_orderkey::VARCHAR AS url, 't' || (o_orderkey % 11) AS title, 'c' || (o_custkey % 7) AS company, 'board' AS source,
  {sql_pick(shapes.SALARIES, 'o_orderkey')} AS salary,
  CASE WHEN o_orderkey % 3 > 0 THEN trunc(o_totalprice / 10000)::INT END AS salary_int, '' AS apply_url,
  {sql_pick(shapes.WORKPLACES, 'o_orderkey')} AS workplace_type, '' AS company_url,
  CASE WHEN o_orderkey % 4 > 0 THEN {AS_OF} - (o_orderkey % 40) * 43200 END AS listed_epoch,
  CASE o_orderstatus WHEN 'O' THEN 'saved' WHEN 'F' THEN 'applied' ELSE 'dismissed' END AS status,
  epoch(o_orderdate)::DOUBLE AS saved_at, CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate)::DOUBLE + 60 END AS applied_at, '' AS notes
  FROM orders)"""


def saves(spark, sf_dir):
    """New saves from the order lines: some urls are known, some are not, some come twice."""
    k = F.col("l_orderkey") * 2
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("posting_id"), k.cast("string").alias("url"),
        F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("title"), F.lit("new").alias("company"),
        F.lit("web").alias("source"), F.lit("₹10 LPA").alias("salary"), F.lit(10).alias("salary_int"),
        F.lit("").alias("apply_url"), F.lit("Remote").alias("workplace_type"), F.lit("").alias("company_url"),
        F.lit(AS_OF).cast("bigint").alias("listed_epoch"), (F.lit(AS_OF) + F.col("l_linenumber")).cast("double").alias("saved_at"),
    )


@query(
    "saved_upsert",
    with_(SAVED, f"""latest AS (SELECT (l_orderkey * 2)::VARCHAR AS url, 'n' || max(l_linenumber) AS title,
        {AS_OF} + min(l_linenumber) AS at FROM lineitem GROUP BY l_orderkey)""",
        body=f"""SELECT COALESCE(s.url, n.url) AS url, COALESCE(n.title, s.title) AS title,
          CASE WHEN n.url IS NULL THEN s.company ELSE 'new' END AS company, CASE WHEN n.url IS NULL THEN s.source ELSE 'web' END AS source,
          CASE WHEN n.url IS NULL THEN s.salary ELSE '₹10 LPA' END AS salary, CASE WHEN n.url IS NULL THEN s.salary_int ELSE 10 END AS salary_int,
          '' AS apply_url, CASE WHEN n.url IS NULL THEN s.workplace_type ELSE 'Remote' END AS workplace_type, '' AS company_url,
          CASE WHEN n.url IS NULL THEN s.listed_epoch ELSE {AS_OF} END AS listed_epoch, COALESCE(s.status, 'saved') AS status,
          COALESCE(s.saved_at, n.at)::DOUBLE AS saved_at, s.applied_at, '' AS notes FROM saved s FULL JOIN latest n ON s.url = n.url"""),
)
def saved_upsert(spark, sf_dir):
    return tracking.upsert_saved(saved(spark, sf_dir), saves(spark, sf_dir))


def _snapshot(spark, schema: str, start) -> Snapshot:
    """A bucketed snapshot that begins with the rows of ``start``."""
    out = Snapshot(spark, f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}", schema, buckets=16)
    out.merge(0, start, lambda old, new: new)
    return out


@query("saved_merges", ORACLE["saved_upsert"])
def saved_merges(spark, sf_dir):
    """The saved table after three batches of saves, merged bucket by bucket."""
    table_ = _snapshot(spark, tracking.SAVED_SCHEMA, saved(spark, sf_dir))
    line = F.col("saved_at") - AS_OF
    for number, part in enumerate((line < 3, (line >= 3) & (line < 5), line >= 5), 1):
        table_.merge(number, saves(spark, sf_dir).filter(part), tracking.upsert_saved)
    table_.vacuum()
    return table_.read()


@query(
    "seen_merges",
    with_(SIGHTINGS, """merged AS (SELECT url, first(title ORDER BY seen_at, posting_id) AS title,
      first(company ORDER BY seen_at, posting_id) AS company, first(source ORDER BY seen_at, posting_id) AS source,
      min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS seen_count FROM sightings WHERE url <> '' GROUP BY url)""", body="SELECT * FROM merged"),
)
def seen_merges(spark, sf_dir):
    """The seen table after two batches of sightings, merged bucket by bucket."""
    table_ = _snapshot(spark, tracking.SEEN_SCHEMA, history(spark, sf_dir))
    rows = batch(spark, sf_dir).withColumn("url", F.trim("url")).filter("url <> ''")
    middle = rows.agg(F.floor(F.avg("seen_at"))).first()[0] or 0
    for number, part in enumerate((F.col("seen_at") < middle, F.col("seen_at") >= middle), 1):
        table_.merge(number, rows.filter(part), lambda old, new: tracking.upsert_seen(old, new).drop("is_new"))
    return table_.read()


CHANGES = ["applied", "offer", "archived", "dismissed", "interview", "rejected"]


def changes(spark, sf_dir):
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        k.cast("string").alias("url"), pick(CHANGES, k + F.col("l_linenumber")).alias("status"),
        (F.lit(AS_OF) + F.col("l_linenumber")).cast("double").alias("at"), F.col("l_linenumber").alias("seq"),
    )


@query(
    "status_changes",
    with_(SAVED, f"""moves AS (SELECT l_orderkey::VARCHAR AS url, {sql_pick(CHANGES, 'l_orderkey + l_linenumber')} AS status,
        ({AS_OF} + l_linenumber)::DOUBLE AS moved FROM lineitem),
      last AS (SELECT url, arg_max(status, moved) AS status, max(moved) FILTER (status = 'applied') AS applied
        FROM moves WHERE status <> 'archived' GROUP BY url)""",
        body="""SELECT s.url, COALESCE(l.status, s.status) AS status, COALESCE(l.applied, s.applied_at) AS applied_at
          FROM saved s LEFT JOIN last l USING (url)"""),
)
def status_changes(spark, sf_dir):
    return tracking.change_status(saved(spark, sf_dir), changes(spark, sf_dir)).select("url", "status", "applied_at")


@query("status_merges", ORACLE["status_changes"])
def status_merges(spark, sf_dir):
    """Status changes in two batches, merged bucket by bucket; urls that were never saved touch buckets but stay unsaved."""
    table_ = _snapshot(spark, tracking.SAVED_SCHEMA, saved(spark, sf_dir))
    for number, part in enumerate((F.col("seq") < 4, F.col("seq") >= 4), 1):
        table_.merge(number, changes(spark, sf_dir).filter(part), tracking.change_status)
    return table_.read().select("url", "status", "applied_at")


@query(
    "saved_view",
    with_(SAVED, body=f"""SELECT url, title, company, source, salary_int, listed_epoch,
      CASE WHEN salary <> '' THEN salary WHEN salary_int > 0 THEN salary_int || ' LPA' ELSE '' END AS salary_cell,
      CASE WHEN COALESCE(listed_epoch, 0) = 0 THEN '' WHEN floor(({AS_OF} - listed_epoch) / 86400.0) <= 0 THEN 'today'
        ELSE floor(({AS_OF} - listed_epoch) / 86400.0)::INT || 'd' END AS posted_cell
      FROM saved WHERE status <> 'dismissed'"""),
)
def saved_view(spark, sf_dir):
    view = tracking.saved_view(saved(spark, sf_dir))
    return view.select(
        "url", "title", "company", "source", "salary_int", "listed_epoch",
        tracking.salary_cell(F.col("salary"), F.col("salary_int")).alias("salary_cell"),
        tracking.posted_cell(F.col("listed_epoch"), as_of()).alias("posted_cell"),
    )


@query(
    "saved_flags",
    with_(SAVED, body="""SELECT l_orderkey, l_linenumber, s.url IS NOT NULL AS is_saved FROM lineitem l
      LEFT JOIN (SELECT url FROM saved WHERE status <> 'dismissed') s ON (l.l_orderkey * 2)::VARCHAR = s.url"""),
)
def saved_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 2).cast("string").alias("url")
    )
    return tracking.with_saved(lines, saved(spark, sf_dir)).select("l_orderkey", "l_linenumber", "is_saved")


# --- scorer cache ----------------------------------------------------------------


def cache(spark, sf_dir):
    k = F.col("conv_id") % 97
    rows = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("task"), k.cast("string").alias("key"), F.col("text").alias("value"),
        (F.lit(AS_OF) - F.col("turn") * 86400 - F.col("conv_id")).cast("double").alias("created"),
    )
    return tracking.cache_put(rows.limit(0), rows)


CACHE = f"""
cache AS (SELECT task, key, arg_max(value, created) AS value, max(created) AS created FROM (
  SELECT role AS task, (conv_id % 97)::VARCHAR AS key, text AS value, ({AS_OF} - turn * 86400 - conv_id)::DOUBLE AS created
  FROM conversations) GROUP BY task, key)"""


@query("cache_latest", with_(CACHE, body="SELECT task, key, value, created FROM cache"))
def cache_latest(spark, sf_dir):
    return cache(spark, sf_dir)


@query(
    "cache_reads",
    with_(CACHE, body=f"""SELECT doc_id, c.value IS NOT NULL AS hit FROM documents d LEFT JOIN cache c
      ON c.task = 'user' AND c.key = (d.doc_id % 150)::VARCHAR AND {AS_OF} - c.created <= 90000"""),
)
def cache_reads(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("user").alias("task"), (F.col("doc_id") % 150).cast("string").alias("key")
    )
    return tracking.cache_get(wanted, cache(spark, sf_dir), 90000, as_of()).select(
        "doc_id", F.col("value").isNotNull().alias("hit")
    )


@query("cache_prune", with_(CACHE, body=f"SELECT task, key FROM cache WHERE created >= {AS_OF} - 7 * 86400"))
def cache_prune(spark, sf_dir):
    return tracking.cache_prune(cache(spark, sf_dir), as_of()).select("task", "key")


@query(
    "cache_keys",
    "SELECT doc_id, sha256('score' || chr(0) || '{\"v\":' || doc_id || '}' || chr(0) || '{\"v\":\"' || lang || '\"}') AS key FROM documents",
)
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tracking.cache_key(F.lit("score"), F.col("doc_id"), F.col("lang")).alias("key")
    )


@query(
    "scorer_work_list",
    with_(CACHE, f"""ranked AS (SELECT doc_id % 5 AS profile_id, doc_id AS rank, (doc_id % 150)::VARCHAR AS key FROM documents),
      looked AS (SELECT r.*, c.value IS NOT NULL AS hit FROM ranked r LEFT JOIN cache c
        ON c.task = 'user' AND c.key = r.key AND {AS_OF} - c.created <= 90000),
      numbered AS (SELECT *, CASE WHEN NOT hit THEN row_number() OVER (PARTITION BY profile_id, hit ORDER BY rank) END AS call_no FROM looked)""",
        body="SELECT profile_id, rank, hit, call_no FROM numbered WHERE hit OR call_no <= 60"),
)
def scorer_work_list(spark, sf_dir):
    ranked = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 5).alias("profile_id"), F.col("doc_id").alias("rank"), F.lit("user").alias("task"),
        (F.col("doc_id") % 150).cast("string").alias("key"),
    )
    work = tracking.work_list(ranked, cache(spark, sf_dir), 90000, 60, ["profile_id"], as_of())
    return work.select("profile_id", "rank", F.col("value").isNotNull().alias("hit"), "call_no")


# --- source runs -------------------------------------------------------------------


def source_runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("string").alias("source"), F.col("event_id").alias("run_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double").alias("ts"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("HTTP "), (F.col("event_id") % 3 + 500).cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("errors"),
    )


RUNS = """
source_runs AS (SELECT (user_id % 8)::VARCHAR AS source, event_id AS run_id, floor(epoch(ts))::DOUBLE AS ts,
  event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'HTTP ' || (event_id % 3 + 500) END AS error FROM events),
islands AS (SELECT *, count(*) FILTER (ok) OVER w AS oks, count(*) FILTER (NOT ok) OVER w AS bads,
    row_number() OVER (PARTITION BY source ORDER BY ts DESC, run_id DESC) AS back
  FROM source_runs WINDOW w AS (PARTITION BY source ORDER BY ts, run_id)),
streaks AS (SELECT *, row_number() OVER (PARTITION BY source, oks, ok ORDER BY ts, run_id) AS fail_no,
    row_number() OVER (PARTITION BY source, bads, ok ORDER BY ts, run_id) AS ok_no FROM islands),
state AS (SELECT source, CASE WHEN ok THEN ok_no ELSE 0 END AS ok_streak, CASE WHEN ok THEN 0 ELSE fail_no END AS fail_streak,
    COALESCE((SELECT max(ts) FROM source_runs r WHERE r.source = s.source AND r.ok), 0.0) AS last_ok,
    CASE WHEN NOT ok AND fail_no >= 3 THEN ts + 1800 ELSE 0.0 END AS cooldown_until FROM streaks s WHERE back = 1)"""

#: The moment just after the last event, so that open circuits show.
LATE = 1706572800


@query("breaker_state", with_(RUNS, body=f"SELECT source, ok_streak, fail_streak, last_ok, cooldown_until, cooldown_until > {LATE} AS is_open FROM state"))
def breaker_state(spark, sf_dir):
    return runs.breaker_state(source_runs(spark, sf_dir), F.lit(LATE).cast("double"))


@query(
    "source_health",
    with_(RUNS, body=f"""SELECT source, CASE WHEN cooldown_until > {LATE} THEN 'error' WHEN fail_streak > 0 THEN 'warn' ELSE 'ok' END AS status,
      CASE WHEN cooldown_until > {LATE} THEN 'circuit OPEN (cooldown until skip)' ELSE '' END AS message, last_ok,
      (SELECT count(*) FROM source_runs r WHERE r.source = s.source) AS n_runs,
      (SELECT count(*) FROM source_runs r WHERE r.source = s.source AND NOT r.ok) AS n_failed FROM state s"""),
)
def source_health(spark, sf_dir):
    return runs.health(source_runs(spark, sf_dir), F.lit(LATE).cast("double")).select(
        "source", "status", "message", "last_ok", "n_runs", "n_failed"
    )


@query("errors_per_source", with_(RUNS, body="SELECT source, error, count(*) AS n FROM source_runs WHERE error IS NOT NULL GROUP BY ALL"))
def errors_per_source(spark, sf_dir):
    return runs.errors_per_source(source_runs(spark, sf_dir))


@query("rows_per_source", with_(POSTINGS, body="SELECT source, count(*) AS n_rows FROM postings GROUP BY source"))
def rows_per_source(spark, sf_dir):
    return runs.rows_per_source(shapes.postings(spark, sf_dir))


@query(
    "arrived_in_time",
    f"""SELECT event_id FROM (SELECT event_id, epoch(ts) AS arrived_at, epoch(date_trunc('hour', ts)) AS started_at FROM events)
      WHERE arrived_at <= started_at + 120""",
)
def arrived_in_time(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(
        "event_id", (F.unix_micros(at) / 1000000).alias("arrived_at"),
        F.unix_timestamp(F.date_trunc("hour", at)).cast("double").alias("started_at"),
    )
    return runs.within_budget(rows).select("event_id")


BACKENDS = ["opencli", "html", "ddgs"]


@query(
    "backend_choice",
    f"""WITH b AS (SELECT event_id, (user_id % 8)::VARCHAR AS source, (user_id // 8)::VARCHAR AS query,
        {sql_pick(BACKENDS + ['other'], 'event_id')} AS backend, event_type <> 'error' AS could_run FROM events),
      p AS (SELECT *, list_position(['html', 'opencli', 'ddgs'], backend) AS place FROM b WHERE could_run AND backend <> 'other')
      SELECT event_id FROM p JOIN (SELECT source, query, min(place) AS place FROM p GROUP BY ALL) m USING (source, query, place)""",
)
def backend_choice(spark, sf_dir):
    b = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 8).cast("string").alias("source"),
        F.floor(F.col("user_id") / 8).cast("string").alias("query"),
        pick(BACKENDS + ["other"], F.col("event_id")).alias("backend"), (F.col("event_type") != "error").alias("could_run"),
    )
    return runs.first_backend(b, BACKENDS, "html").select("event_id")


def run_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.floor(F.col("item_id") / 6).cast("bigint").alias("run_id"), (F.col("item_id") % 6 + 1).alias("query_no"),
        F.col("text").alias("query"), pick(["Pune", "", "Remote"], F.col("item_id")).alias("location"),
    )


RUN_QUERIES = f"""
run_queries AS (SELECT item_id // 6 AS run_id, item_id % 6 + 1 AS query_no, text AS query,
  {sql_pick(['Pune', '', 'Remote'], 'item_id')} AS location FROM benchmark)"""
_SOURCES = ["LinkedIn", "Indeed", "Naukri", "RemoteOK", "Web Search", "Career Sites"]


@query(
    "query_plan",
    with_(RUN_QUERIES, f"s(source) AS (SELECT unnest({sql_list(_SOURCES)}))",
        body="""SELECT run_id, query_no, query, location, source, source = 'Indeed' AND query_no = 1 AS recover_titles
          FROM run_queries, s"""),
)
def query_plan(spark, sf_dir):
    return runs.query_plan(run_queries(spark, sf_dir), _SOURCES)


@query(
    "site_query_plan",
    with_(RUN_QUERIES, "q AS (SELECT run_id, query_no, query || ' ' || location AS base FROM run_queries)",
        "hosts AS (SELECT array_agg(d ORDER BY d) AS ds FROM (SELECT DISTINCT 'careers.' || lower(replace(s_name, '#', '-')) || '.com' AS d FROM supplier ORDER BY d))",
        f"""web AS (SELECT run_id, query_no, 'web' AS plan, unnest(list_transform({sql_list(fixed.POSTING_HOSTS)},
            lambda h: 'site:' || h || ' ' || base) || [base || ' career']) AS site_query FROM q),
          boards AS (SELECT run_id, query_no, 'boards' AS plan, unnest(list_transform({sql_list(fixed.BOARD_HOSTS)} || ds,
            lambda h: 'site:' || h || ' ' || base)) AS site_query FROM q, hosts)""",
        body="SELECT * FROM web UNION ALL SELECT * FROM boards"),
)
def site_query_plan(spark, sf_dir):
    q = run_queries(spark, sf_dir)
    domains = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("careers."), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".com")).alias("domain")
    )
    web = runs.web_site_queries(q).select("run_id", "query_no", F.lit("web").alias("plan"), "site_query")
    boards = runs.board_site_queries(q, domains).select("run_id", "query_no", F.lit("boards").alias("plan"), "site_query")
    return web.unionByName(boards)


# --- documents ----------------------------------------------------------------------


@query(
    "run_totals",
    with_(SCORED, body="""SELECT count(*) AS found_count, count(*) FILTER (data_quality = 'full') AS enriched_count,
      count(*) FILTER (score >= 60) AS verdict_count FROM scored"""),
)
def run_totals(spark, sf_dir):
    rows = scored(spark, sf_dir).select(
        F.lit(True).alias("found"), F.coalesce(F.col("data_quality") == "full", F.lit(False)).alias("enriched"),
        (F.col("score") >= 60).alias("verdict"),
    )
    return documents.totals(rows)


@query(
    "result_lines",
    with_(SCORED, body="""SELECT posting_id, score AS match_score, title, company, url, array_to_string(reasons, '; ') AS reasons,
      rank FROM ranked WHERE rank <= 30"""),
)
def result_lines(spark, sf_dir):
    """The rows of a result document, read back from their JSON form."""
    from ..operators.rank import top_n

    best = top_n(scored(spark, sf_dir), 30, ["profile_id"])
    lines = documents.job_lines(best, ["posting_id", "title", "company", "url"])
    back = F.from_json("job", "posting_id BIGINT, title STRING, company STRING, url STRING, match_score DOUBLE, reasons ARRAY<STRING>")
    return lines.select("rank", back.alias("j")).select(
        "rank", "j.posting_id", "j.match_score", "j.title", "j.company", "j.url", F.array_join("j.reasons", "; ").alias("reasons")
    )
