"""The committed sink and the closing of runs."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from worklens.sinks import committed
from worklens.streaming import arrivals, breaker

ROW = "run_id long, rank long, body string"


def test_a_failed_or_repeated_write_leaves_nothing(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "out")
    rows = spark.range(40).select((F.col("id") % 2).alias("run_id"), F.col("id").alias("rank"), F.col("id").cast("string").alias("body")).repartition(4)
    broken = rows.withColumn("body", F.when(F.col("rank") == 33, F.raise_error(F.lit("half way")).cast("string")).otherwise(F.col("body")))
    assert committed.read(spark, path, ROW).count() == 0
    with pytest.raises(Exception, match="half way"):
        broken.write.format("committed_rows").option("path", path).option("batch", "7").mode("append").save()
    assert committed.read(spark, path, ROW).count() == 0
    for _ in range(2):  # the second time it is there already
        rows.write.format("committed_rows").option("path", path).option("batch", "7").mode("append").save()
        assert committed.read(spark, path, ROW).count() == 40
    published = {line for f in Path(path, "commits").iterdir() if f.name == "7" for line in f.read_text().split()}
    assert len(published) == 4
    rows.where("false").write.format("committed_rows").option("path", path).option("batch", "8").mode("append").save()
    assert committed.read(spark, path, ROW).count() == 40


def test_a_run_is_closed_once_with_what_came_in_time(spark, tmp_path):
    schema = "run_id long, batch_id long, source string, started_at double, arrived_at double"
    parts = [[(1, 1, "a", 1000.0, 1010.0), (1, 2, "b", 1000.0, 1120.0), (1, 3, "c", 1000.0, 1121.0)], [(1, 4, "a", 1000.0, 1100.0), (2, 5, "a", 2000.0, 2500.0)], [(3, 6, "z", 3000.0, 3001.0)]]
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"landed={number}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "landed=*"))
        with breaker.keyed_state(spark):
            out = arrivals.arrivals(stream, "60 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(arrivals.ARRIVALS).parquet(str(tmp_path / "out")).collect()
    assert {(r.batch_id, r.kind) for r in got if r.kind != "closed"} == {(1, "used"), (2, "used"), (3, "late"), (4, "used"), (5, "late"), (6, "used")}
    assert [(r.run_id, r.at, r.n_used, r.n_sources) for r in got if r.kind == "closed"] == [(1, 1120.0, 3, 2)]
