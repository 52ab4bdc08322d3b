"""Payload shapes of the real sources, and the package on workers that don't have it."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from worklens.operators import enrich, rank
from worklens.sources import payloads, trees

REPO = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
DEEP = '{"a":' * 5000 + "1" + "}" * 5000


def test_deep_and_broken_json_hold_nothing(spark):
    rows = [(1, DEEP), (2, "[" * 100_000), (3, "no json"), (4, None), (5, '{"x": [1, {"results": [{"title": "t"}, 3]}]}')]
    got = spark.createDataFrame(rows, "k int, payload string").select(
        "k", payloads.nested_parts("payload")["rows"].alias("n"), payloads.envelope_rows("payload").alias("e"), payloads.envelope_error("payload").alias("x")
    )
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, None, "[]", None), (2, None, "[]", None), (3, None, "[]", None), (4, None, "[]", None), (5, '[{"title": "t"}]', "[]", None)]


def test_tree_walk():
    assert trees.message({"error": {"msg": " late "}, "message": "x"}) == "late"
    assert trees.message({"error": {"code": 1}, "message": "x"}) == "x" and trees.message([{"a": 1}, '{"msg": "inner"}']) == "inner"
    deep = {"title": "t", "description": "d"}
    for _ in range(3000):
        deep = {"inner": [deep]}
    assert trees.described_job(deep) == {"title": "t", "description": "d"}
    assert trees.result_list({"a": {"b": {"c": {"d": {"results": [1]}}}}}) == [1] and trees.result_list({"a": {"b": {"c": {"d": {"e": {"results": [1]}}}}}}) is None


@pytest.mark.parametrize(
    "html, title, company",
    [
        ('<div class="job_seen_beacon"><span title="New">New</span><h3 class="jobTitle"><a href="/x"><span title="t">Real</span></a></h3></p><span data-testid="company-name">Acme</span></div>', "Real", "Acme"),
        ('<div data-jk="1"><h3 class="jobTitle"><a href="/x">Plain</a></h3></b><i><span data-testid="company-name">Acme</span></div>', "Plain", "Acme"),
        ('<div data-jk="1"><a class="jcs-JobTitle" href="/x">No heading</a></div>', "", ""),
    ],
)
def test_board_cards(html, title, company):
    card = json.loads(payloads.cards_json(html, "board"))[0]
    assert (card["title"], card["company"]) == (title, company)


def test_posting_page_quotes_and_zero_years(spark):
    ld = '{"@type":"JobPosting","title":"Dev","description":"d"}'
    state = '{"job":{"title":"Ops","description":"d","minExperience":0,"maxExperience":3,"location":{"address":{"addressLocality":"Pune"}}}}'
    rows = [(f"u{i}", f"<html><script type={q}>{ld}</script></html>") for i, q in enumerate(["'application/ld+json'", '"application/ld+json"', "application/ld+json"])]
    rows += [("u3", f"<html><script id='__NEXT_DATA__'>{state}</script></html>"), ("u4", "<html><body>nothing</body></html>")]
    got = {r.url: r.page for r in payloads.posting_page(spark.createDataFrame(rows, "url string, payload string")).collect()}
    assert [got[f"u{i}"].title for i in range(4)] == ["Dev"] * 3 + ["Ops"]
    assert (got["u3"].experience, got["u3"].location) == ("3", "Pune") and got["u4"] is None


def test_newest_detail_wins_and_rows_stay_single(spark):
    posts = spark.createDataFrame([(1, "Indeed", "", "k1", "old"), (2, "Indeed", "", "k2", "old"), (3, "Other", "", "k1", "old")], "posting_id int, source string, url string, job_key string, description string")
    posts = posts.withColumns({c: F.lit("") for c in ("job_type", "salary", "data_quality")})
    details = spark.createDataFrame([("k1", "zz first", 1), ("k1", "aa second", 2)], "job_key string, description string, landed_at int").withColumns({c: F.lit("") for c in ("job_type", "salary", "url")})
    got = {r.posting_id: r.description for r in enrich.board_details(posts, details).collect()}
    assert got == {1: "aa second", 2: "old", 3: "old"} and enrich.board_details(posts, details).count() == 3
    crawl = spark.createDataFrame([("u", 404, "u", "", 1), ("u", 200, "u", "fine", 2), ("v", 404, "v", "", 3)], "url string, status int, final_url string, body string, landed_at int")
    assert [r.url for r in enrich.live_only(spark.createDataFrame([("u",), ("v",)], "url string"), crawl).collect()] == ["u"]


def test_override_keeps_the_row(spark):
    long = "d" * 400
    df = spark.createDataFrame([(1, 7, 10.0, ["a"], "full", long)], "profile_id int, posting_id int, score double, reasons array<string>, data_quality string, description string")
    scores = spark.createDataFrame([(1, 7, 50.0, ["x"], 1), (1, 7, 60.0, ["y"], 2)], "profile_id int, posting_id int, external_score double, external_reasons array<string>, landed_at int")
    for n in (None, 5):
        (row,) = rank.override(df, scores, ["profile_id"], n).collect()
        assert (row.score, row.reasons, row.description, row.overridden) == (60.0, ["y"], long, True)


def test_workers_get_the_package_from_any_folder(tmp_path):
    script = f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import __spark_entry__ as entry
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
        print("rows", entry.queries()["name_similarity"](spark, "/root/testdata/sf0.001").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows " in run.stdout, run.stderr[-2000:]
