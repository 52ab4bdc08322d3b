"""Landed lines as a table and as a stream; calls of a user scorer."""

import pandas as pd
from pyspark.sql import functions as F

from worklens.operators import scorer
from worklens.sources import landing


def land(folder, name, files, done=True):
    (folder / name).mkdir(parents=True)
    for file, data in files.items():
        (folder / name / file).write_bytes(data)
    if done:
        (folder / name / "_SUCCESS").write_bytes(b"")


def test_lines_of_cut_files(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i * 7 % 50) for i in range(300)] + ["é ü", "z" * 5000]
    land(tmp_path, "001", {"a": "\n".join(texts).encode(), "b": b"\r\n \nlast\r\n", "empty": b"", "_hidden": b"no"})
    for part in (1, 17, 64, 10_000):
        got = landing.lines(spark, str(tmp_path), stream=False, part_bytes=part).collect() if part > 1 else None
        if got is not None:
            assert sorted(r.line for r in got) == sorted([*texts, "last"])
            assert len({(r.file, r.at) for r in got}) == len(got)
    assert landing.lines(spark, str(tmp_path / "nowhere"), stream=False).count() == 0


def test_a_stream_goes_on_behind_its_last_landing(spark, tmp_path):
    folder = tmp_path / "in"

    def run():
        found = landing.records(landing.lines(spark, str(folder)), "k long")
        writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(((r.landed, r.k, r.corrupt) for r in spark.read.schema("landed string, k long, corrupt string").parquet(str(tmp_path / "out")).collect()), key=str)

    land(folder, "001", {"a": b'{"k": 1}\n{"k": 2}\n'})
    land(folder, "003", {"a": b'{"k": 9}\n'}, done=False)
    first = [("001", 1, None), ("001", 2, None)]
    assert run() == first
    (folder / "001" / "a").touch()  # another time of the file is no new landing
    assert run() == first
    land(folder, "002", {"a": b'{"k": 3}\nbroken'})
    assert [r for r in run() if r[0] == "002"] == [("002", 3, None)] or [r[2] for r in run() if r[0] == "002" and r[1] is None] == ["broken"]
    (folder / "003" / "_SUCCESS").touch()
    assert [(r[0], r[1]) for r in run() if r[1] is not None] == [("001", 1), ("001", 2), ("002", 3), ("003", 9)]


def test_a_failing_call_costs_one_row(spark):
    work = spark.range(57).select(F.col("id"), F.col("id").cast("string").alias("prompt_facts")).coalesce(2)

    def scores(frame: pd.DataFrame) -> pd.Series:
        if (frame["id"] == 13).any():
            raise ValueError("thirteen")
        return frame["prompt_facts"].iloc[1:] if (frame["id"] == 40).any() else "a" + frame["prompt_facts"]

    for rows, at_once in ((None, 1), (5, 3)):
        got = {r["id"]: r["answer"] for r in scorer.call_scorer(work, scores, rows, at_once, retries=1).collect()}
        assert got == {i: None if i in (13, 40) else f"a{i}" for i in range(57)}
