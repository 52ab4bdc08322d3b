"""Filter report, ranks, streams and documents."""

import json
from random import Random

from pyspark.sql import functions as F

from worklens.catalog import shapes
from worklens.catalog.filtering import CANDIDATE, OPTIONS
from worklens.operators import filters, rank, runs, tracking
from worklens.operators.filters import FilterOptions, Profile
from worklens.plans import search
from worklens.sinks import documents
from worklens.streaming import breaker
from worklens.streaming import watch as streams

SF = "/root/testdata/sf0.001"


def now():
    return F.lit(1706659200.0)


ROWS = [
    (1, "Platform Engineer", "Acme", "Pune", "₹28-35 LPA", "2 days ago", "aws docker kubernetes", "https://x/1"),
    (2, "DevOps Jobs", "Acme", "Pune", "₹28-35 LPA", "2 days ago", "aws docker kubernetes", "https://x/2"),
    (3, "Platform Engineer", "Acme", "Pune", "₹28-35 LPA", "90 days ago", "aws docker kubernetes", "https://x/3"),
    (4, "Platform Engineer", "Acme", "Pune", "₹28-35 LPA", "2 days ago", "cobol", "https://x/4"),
    (5, "Platform Engineer", "Acme", "Chennai", "₹28-35 LPA", "2 days ago", "aws docker kubernetes", "https://x/5"),
    (6, "Platform Engineer", "Acme", "Pune", "₹3-4 LPA", "2 days ago", "aws docker kubernetes", "https://x/6"),
]
SCHEMA = "posting_id bigint, title string, company string, location string, salary string, listed string, description string, url string"
PERSON = Profile(title="Platform Engineer", location="Pune", skills=("aws",), must_have_skills=("kubernetes",), min_salary=20, experience="4")


def test_one_row_fails_each_stage(spark):
    marked = search.marked(spark.createDataFrame(ROWS, SCHEMA), PERSON, FilterOptions(days=7), now())
    report = {r["name"]: (r["kept"], r["dropped"]) for r in filters.report(marked).collect()}
    assert report == {"quality": (5, 1), "age": (4, 1), "must-skills": (3, 1), "location": (2, 1), "salary": (1, 1)}
    assert [r["posting_id"] for r in filters.kept(marked).collect()] == [1]


def test_bad_option_passes_the_stage(spark):
    marked = search.marked(spark.createDataFrame(ROWS, SCHEMA), PERSON, FilterOptions(days="soon"), now())
    assert {r["name"]: r["dropped"] for r in filters.report(marked).collect()}["age"] == 0


def test_full_rank_equals_sort(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("g"), F.col("id").alias("posting_id"), (F.pmod(F.xxhash64("id"), F.lit(40)) / 10).alias("score")
    )
    rows = df.collect()
    got = {(r["g"], r["posting_id"]): r["rank"] for r in rank.full_rank(df, ["g"]).collect()}
    for g in range(3):
        order = sorted((r for r in rows if r["g"] == g), key=lambda r: (-r["score"], r["posting_id"]))
        assert all(got[(g, r["posting_id"])] == i for i, r in enumerate(order, 1))


def test_stream_equals_batch(spark, tmp_path):
    shapes.postings(spark, SF).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = {(r["posting_id"], r["score"]) for r in search.scored(batch, CANDIDATE, OPTIONS, now()).collect()}
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.watch(stream, CANDIDATE, OPTIONS, str(tmp_path / "out"), str(tmp_path / "cp"), now())
    q.awaitTermination()
    new = spark.read.parquet(str(tmp_path / "out" / "new"))
    got = {(r["posting_id"], r["score"]) for r in new.collect()}
    assert got <= want and len(want) > 0
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "current").iterdir() if "=" in p.name)
    seen = streams.seen_now(spark, str(tmp_path / "out"), last)
    urls = {r["url"] for r in seen.collect()}
    assert urls == {r["url"] for r in search.scored(batch, CANDIDATE, OPTIONS, now()).select("url").collect() if r["url"].strip()}
    assert {r["url"] for r in new.collect()} == urls
    assert sum(r["seen_count"] for r in seen.collect()) == len(want)


def test_seen_counts_stream(spark, tmp_path):
    rows = [(1, "u1", 1.0), (2, "u1", 2.0), (3, "u2", 3.0), (4, " ", 4.0)]
    df = spark.createDataFrame(rows, "posting_id bigint, url string, seen_at double").withColumns(
        {"title": F.lit("t"), "company": F.lit("c"), "source": F.lit("s")}
    )
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.seen_counts(stream).writeStream.format("memory").queryName("seen_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["url"], r["seen_count"]) for r in spark.sql("select * from seen_now").collect()} == {("u1", 2), ("u2", 1)}


def test_breaker_takes_runs_in_any_order(spark, tmp_path):
    random = Random(4)
    ends = {"a": [True, False, False, False, False], "b": [False, False, False, True, True], "c": [random.random() < 0.3 for _ in range(60)]}
    rows = [(source, 1e6 + 700.0 * i, i, ok) for source, oks in ends.items() for i, ok in enumerate(oks)]
    schema = "source string, ts double, run_id bigint, ok boolean"
    want = {r["source"]: tuple(r)[:5] for r in runs.breaker_state(spark.createDataFrame(rows, schema), F.lit(0.0)).collect()}
    shuffled = random.sample(rows, len(rows))
    for number in range(3):
        # Each start goes on from the checkpoint; nothing is counted twice.
        spark.createDataFrame(shuffled[number::3], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"landed={number}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "landed=*"))
        with breaker.keyed_state(spark):
            changes = breaker.breaker_changes(stream, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            changes.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(breaker.CHANGES).parquet(str(tmp_path / "out"))
    assert {r["source"]: tuple(r) for r in breaker.latest_state(out).collect()} == want


def test_breaker_closes_by_timer(spark, tmp_path):
    """The cooldown of a source ends though none of its runs follows: the watermark goes on with other sources."""
    schema = "source string, ts double, run_id bigint, ok boolean"
    parts = [[("a", 100.0 * i, i, False) for i in range(1, 5)], [("b", 2000.0, 9, True)], [("b", 2300.0, 10, True)]]
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"landed={number}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "landed=*"))
        with breaker.keyed_state(spark):
            changes = breaker.breaker_changes(stream, "10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            changes.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(breaker.CHANGES).parquet(str(tmp_path / "out")).where("change <> 'state'").orderBy("seq").collect()
    assert [(r["source"], r["change"], r["at"]) for r in out] == [("a", "opened", 300.0), ("a", "closed", 2200.0)]


def test_watch_counts(spark):
    schema = "posting_id bigint, url string, title string, company string, source string, seen_at double"
    before = tracking.sightings(spark.createDataFrame([(1, "u1", "t", "c", "s", 1.0)], schema))
    batch = spark.createDataFrame([(1, "u1", "t2", "c", "s", 2.0), (2, "u2", "t", "c", "s", 2.0)], schema)
    flags = {r["url"]: r["is_seen"] for r in tracking.with_seen(batch, before).collect()}
    assert flags == {"u1": True, "u2": False}
    after = {r["url"]: r for r in tracking.upsert_seen(before, batch).collect()}
    assert len(after) == 2 and after["u1"]["seen_count"] == 2 and after["u1"]["title"] == "t" and after["u2"]["is_new"]


def test_document(spark):
    ranked = spark.createDataFrame([(7, 1, "A", 61.25, ["x"]), (7, 2, "B", 5.0, [])], "run_id int, rank int, title string, score double, reasons array<string>")
    lines = documents.job_lines(ranked, ["title"])
    head = documents.header(spark.createDataFrame([(7, "devops")], "run_id int, query string"))
    doc = json.loads(documents.document(head, lines, 10).first()["document"])
    assert doc["command"] == "search" and doc["query"] == "devops" and doc["found_count"] == 0
    assert [(j["title"], j["match_score"]) for j in doc["jobs"]] == [("A", 61.2), ("B", 5.0)]


def test_backend_order():
    assert runs.ordered_backends(["a", "b", "c"], "c") == ["c", "a", "b"]
    assert runs.ordered_backends(["a", "b"], "zzz") == ["a", "b"]
