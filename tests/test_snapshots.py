"""Bucketed snapshots and the index of kept postings."""

import random

from pyspark.sql import functions as F

from worklens.operators import dedup, kept, tracking
from worklens.sinks.snapshots import Snapshot

ROW = "title string, company string, source string, salary string, salary_int int, apply_url string, workplace_type string, company_url string, listed_epoch bigint"


def saves(spark, urls, title, at):
    rows = [(i, u, title, "c", "s", "", 1, "", "", "", 0, float(at)) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, f"posting_id long, url string, {ROW}, saved_at double")


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "saved"), tracking.SAVED_SCHEMA, buckets=128)
    first = saves(spark, [f"u{i}" for i in range(600)], "old", 1)
    table.merge(0, first, tracking.upsert_saved)
    small = saves(spark, ["u7", "u8", "new", None], "fresh", 2)
    touched = table.merge(1, small, tracking.upsert_saved)
    entries = table.entries()
    assert len(touched) <= 3 and {b for b, e in entries.items() if e.version == 1} == set(touched)
    assert table.merge(1, small, tracking.upsert_saved) == []  # the same batch again changes nothing
    whole = tracking.upsert_saved(tracking.upsert_saved(spark.createDataFrame([], tracking.SAVED_SCHEMA), first), small.where("url is not null"))
    as_set = lambda df: {tuple(r) for r in df.select(*table.read().columns).collect()}
    assert as_set(table.read()) == as_set(whole) and table.read().count() == 601
    assert {r.url: r.title for r in table.lookup(spark.createDataFrame([("u7",), ("u9",), ("zzz",)], "url string")).collect()} == {"u7": "fresh", "u9": "old"}
    assert table.read(0).count() == 600 and table.vacuum() == len([b for b in touched if b in table_buckets(first, spark)])
    assert as_set(table.read()) == as_set(whole)


def table_buckets(df, spark):
    return {r[0] for r in df.select(F.pmod(F.xxhash64("url"), F.lit(128)).cast("int")).collect()}


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "saved"), tracking.SAVED_SCHEMA, buckets=4)
    table.merge(0, saves(spark, ["a", "b"], "old", 1), tracking.upsert_saved)
    commit, table._commit = table._commit, lambda *a: 1 / 0
    try:
        table.merge(1, saves(spark, ["a", "c"], "lost", 2), tracking.upsert_saved)
    except ZeroDivisionError:
        pass
    table._commit = commit
    assert {r.url: r.title for r in table.read().collect()} == {"a": "old", "b": "old"}
    table.merge(1, saves(spark, ["a"], "kept", 3), tracking.upsert_saved)
    assert {r.url: r.title for r in table.read().collect()} == {"a": "kept", "b": "old"}
    empty = Snapshot(spark, str(tmp_path / "none"), tracking.SAVED_SCHEMA)
    assert empty.read().count() == 0 and empty.merge(0, saves(spark, [], "", 0), tracking.upsert_saved) == [] and empty.read().count() == 0


def test_batches_against_the_index_equal_one_pass(spark, tmp_path):
    rng = random.Random(12)
    words = "senior platform engineer devops cloud data lead qa go".split()
    firms = "acme globex inc labs mastercard ab x".split()

    def spelled(pool):
        out = " ".join(rng.sample(pool, rng.randint(0, 3)))
        at = rng.randrange(len(out) + 1)
        return out[:at] + rng.choice(["", "", "x", "s"]) + out[at:]

    rows = [(i, spelled(words), spelled(firms)) for i in range(90)]
    df = spark.createDataFrame(rows, "posting_id bigint, title string, company string")
    want = {r.posting_id for r in dedup.fuzzy(df).collect()}
    index = kept.KeptIndex(spark, str(tmp_path / "kept"), buckets=8)
    got = set()
    for number in range(3):
        part = df.where(F.floor(F.col("posting_id") / 30) == number)
        got |= {r.posting_id for r in index.keep(part, number).collect()}
        if number == 1:  # the same batch again keeps the same rows
            assert {r.posting_id for r in index.keep(part, number).collect()} <= got
    assert got == want and len(want) < 85
