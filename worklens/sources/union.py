"""Union of source batches with their provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import conform


def stamp(rows: DataFrame, data_quality: str, backend: str) -> DataFrame:
    """Batch values fill the rows that carry none of their own."""
    out = rows
    for name, value in (("data_quality", data_quality), ("backend", backend)):
        own = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(own, F.lit(value)))
    return out


def union(batches: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(rows, data_quality, backend) of each source as one postings table."""
    ready = [conform(stamp(*b)) for b in batches]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ready)
