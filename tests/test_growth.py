"""What decides how queries grow: what is computed once per row, how rows are parted, and what a batch holds."""

from pyspark.sql import functions as F

from worklens.functions import extract, urls
from worklens.functions.base import title_case

SLUG = "https://www.naukri.com/job-listings-"


def test_slug_is_cut_once(spark):
    rows = [
        ("python-developer-varite-kolkata-hyderabad-8-to-13-years-1", "Varite"), ("devops-tata-consultancy-services-pune-2-to-5-years-2", "Tata Consultancy Services"),
        ("sre-acme-solutions-remote-3", "Acme Solutions"), ("pune-mumbai-4", ""), ("x", ""), (None, ""),
    ]
    df = spark.createDataFrame([(None if s is None else SLUG + s, c) for s, c in rows], "url string, company string")
    got = df.select("company", urls.company_from_slug(F.col("url")).alias("found"))
    assert [r.found for r in got.collect()] == [c for _, c in rows]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("job-listings-") == 1


def test_title_case_reads_its_text_once(spark):
    df = spark.createDataFrame([("o'neil AND sons",), ("",), (None,), ("é1a b",)], "t string")
    got = df.select(title_case(F.col("t")).alias("x"))
    assert [r.x for r in got.collect()] == ["O'Neil And Sons", "", None, "É1A B"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(t") == 1


def test_last_crawl_of_a_url_decides(spark, tmp_path):
    from worklens.catalog.sourcing import live_postings

    # Page 1 answered 404, page 40 of the same url is there; page 44 is there, page 46 of the same url is gone.
    rows = [(1, "https://a.example/x", "p"), (40, "https://a.example/x", "p"), (44, "https://b.example/y", "p"), (46, "https://b.example/y", "p")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in live_postings(spark, str(tmp_path)).collect()) == [1, 40]


def test_a_marker_is_sought_in_the_whole_body(spark, tmp_path):
    import duckdb

    import __spark_entry__

    # Pages that answer 200 in place; in 40, 60 and 100 a marker stands wholly or partly behind the first 4096 characters or bytes.
    bodies = {
        40: "x" * 5000 + "This job has EXPIRED", 60: "é" * 4000 + "We're sorry", 100: "x" * 4090 + "page not found" + "x" * 200_000, 140: "position has been filled",
        180: "x" * 5000, 200: "", 240: None, 280: "x" * 5000 + "job  expired",
    }
    rows = [(k, f"https://a.example/x/{k}", html) for k, html in bodies.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    alive = [180, 200, 240, 280]
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sorted(r.page_id for r in queries["live_postings"](spark, str(tmp_path)).collect()) == alive
    assert sorted(k for k, in con.execute(oracle["live_postings"]).fetchall()) == alive
    assert sorted(r.page_id for r in queries["dead_posting_verdict"](spark, str(tmp_path)).collect() if r.alive) == alive


def test_texts_become_objects_piece_by_piece():
    import pyarrow as pa

    from worklens.sources.payloads import PIECE, _each

    texts = [None if i % 7 == 0 else f"t{i}" for i in range(2 * PIECE + 5)]
    assert _each(pa.array(texts), lambda t: t and t.upper()).to_pylist() == [t and t.upper() for t in texts]
    assert _each(pa.array([], pa.string()), str).to_pylist() == []


def test_cards_and_envelopes_are_parsed_in_many_tasks(spark, tmp_path):
    from worklens.catalog import sourcing

    rows = [(k, f"name {k}", "brand", "type") for k in range(1, 400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert sourcing.envelopes(spark, str(tmp_path)).rdd.getNumPartitions() >= 4 * cores
    assert sourcing.search_card_rows(spark, str(tmp_path)).rdd.getNumPartitions() >= 8 * cores


def test_replayed_batches_are_many_files(spark, tmp_path):
    from worklens.catalog import streams

    rows = spark.range(1000).toDF("posting_id")
    seen = []
    stream = streams.replayed(rows, "posting_id", str(tmp_path))
    assert len(spark.read.parquet(f"{tmp_path}/in").inputFiles()) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = stream.writeStream.foreachBatch(lambda batch, number: seen.append(batch.count())).option("checkpointLocation", f"{tmp_path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == streams.PARTS and sum(seen) == 1000 and max(seen) < 600


def test_only_rows_of_running_calls_are_frames(spark):
    import datetime

    from worklens.operators import scorer

    work = spark.range(500).select(
        "id", F.concat(F.lit("p"), "id").alias("prompt_facts"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"), F.lit("2024-01-05 10:00:00").cast("timestamp").alias("at")
    ).coalesce(1)

    def scores(frame):
        import gc

        import pandas as pd

        alive = max(len(x) for x in gc.get_objects() if isinstance(x, pd.DataFrame))
        return frame["id"].astype(str) + f" {alive} " + frame["at"].astype(str)

    got = scorer.call_scorer(work, scores, rows_per_call=50).collect()
    assert [(r.id, r.n, r.answer) for r in sorted(got)] == [(i, i if i % 2 == 0 else None, f"{i} 50 2024-01-05 10:00:00") for i in range(500)]
    assert {r.at for r in got} == {datetime.datetime(2024, 1, 5, 10)}


def _asking(spark, n):
    given = [("Platform Engineer", "", "Pune", "4", "remote", ["aws", "c++"], ["docker"]), ("Data Analyst", "x", None, None, "", None, ["ci/cd"]), ("", "", "", "", "onsite", ["++"], None)]
    kinds = "p_title string, p_headline string, p_location string, p_experience string, p_remote_preference string, p_skills array<string>, p_must_have_skills array<string>"
    return spark.createDataFrame([(i, *given[i % 3]) for i in range(n)], f"profile_id long, {kinds}")


def _offered(spark):
    texts = ["aws and c++ in docker", "xaws c++11 dockerd", "CI/CD ++", "", None, "c#, aws, continuous integration"]
    rows = [(i, ["Platform Engineer", "Data Analyst", ""][i % 3], texts[i % 6], ["Pune", "Remote", ""][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "posting_id long, title string, description string, location string")
    nothing = F.lit(None).cast("string")
    return df.withColumns({"workplace_type": nothing, "workplace": nothing, "listed_epoch": F.lit(None).cast("long"), "remote_ok": F.lit(False), "data_quality": nothing})


def test_profiles_given_alike_are_prepared_once(spark, monkeypatch):
    from worklens.plans import many

    prepared = []
    plain = many.prepare
    monkeypatch.setattr(many, "prepare", lambda rows: prepared.append(rows.count()) or plain(rows))
    got = many.top_matches(_offered(spark), _asking(spark, 30), F.lit(0.0), 4).collect()
    assert prepared == [3]
    best = {i: sorted((r["rank"], r.posting_id, r.score) for r in got if r.profile_id == i) for i in range(30)}
    assert all(len(best[i]) == 4 and best[i] == best[i % 3] for i in range(30))


def test_few_skills_are_sought_without_moving_texts(spark, monkeypatch):
    from worklens.operators.filters import prepare
    from worklens.plans import many

    ready, rows = prepare(_asking(spark, 3)), _offered(spark)
    joins = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = many.evidence(rows, ready)
        assert joins(few) == 0
        monkeypatch.setattr(many, "FEW", 0)
        more = many.evidence(rows, ready)
        assert joins(more) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = sorted(few.collect())
    assert found == sorted(more.collect()) and any(r.feature == "w:c++" for r in found)


def test_a_landing_opens_its_own_files(spark, tmp_path):
    from worklens.catalog import streams

    rows = spark.range(400).toDF("k").repartition(4).withColumn("t", F.when(F.col("k") % 8 != 3, F.col("k").cast("string")))
    one = streams._parted(rows, F.when(F.col("k") < 300, F.col("k") % 3).cast("int"), str(tmp_path))
    files = [set(f for f, in one(n).select(F.input_file_name()).distinct().collect()) for n in range(4)]
    assert all(files[:3]) and not files[3] and len(set.union(*files)) == sum(map(len, files))
    assert "PartitionFilters: [isnotnull(_part" in one(1)._jdf.queryExecution().executedPlan().toString()
    assert [sorted(map(tuple, one(n).collect())) for n in range(4)] == [[(k, None if k % 8 == 3 else str(k)) for k in range(n, 300, 3)] if n < 3 else [] for n in range(4)]
