"""Typed posting columns out of raw text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places, salary, times
from ..functions.base import text

#: Posting columns and types. Text is "" when missing; the two numbers are NULL when unknown.
POSTING_COLUMNS = {
    "title": "string", "company": "string", "location": "string", "description": "string",
    "url": "string", "source": "string", "apply_url": "string", "salary": "string",
    "workplace_type": "string", "job_type": "string", "listed": "string", "applicants": "string",
    "company_url": "string", "backend": "string", "data_quality": "string", "job_key": "string",
    "epoch": "double", "listed_date": "string", "listed_epoch": "bigint", "tags": "array<string>",
}
_KEEP_NULL = {"data_quality", "job_key", "epoch", "listed_epoch", "tags", "backend"}


def conform(df: DataFrame) -> DataFrame:
    """Add the posting columns a source did not deliver and make missing text empty."""
    out = {}
    for name, kind in POSTING_COLUMNS.items():
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out[name] = c if name in _KEEP_NULL else text(c)
    rest = [c for c in df.columns if c not in out]
    return df.select(*rest, *[v.alias(k) for k, v in out.items()])


def normalize(df: DataFrame, as_of: Column) -> DataFrame:
    """Add ``listed_epoch``, ``salary_int``, ``city``, ``region``, ``remote_ok`` and ``workplace``.

    Purely row-wise, so it runs unchanged on a stream and adds no shuffle.
    """
    df = df.withColumns(
        {
            "listed_epoch": times.listed_epoch(
                F.col("listed_epoch"), F.col("listed"), F.col("epoch"), F.col("listed_date"), as_of
            ),
            "salary_int": salary.salary_int(F.col("salary")),
            "city": places.city(F.col("location")),
            "remote_ok": places.is_remote(F.col("location"), F.col("workplace_type"), F.col("description")),
            "workplace": F.col("workplace_type"),
        }
    )
    return df.withColumn("region", places.region_of(F.col("city")))


def provenance_tags(quality: Column, age: Column, salary_tag: Column, loc_tag: Column) -> Column:
    q = F.lower(text(quality))
    return F.array_compact(
        F.array(
            F.when(q.isin("full", "partial", "snippet"), q),
            F.when(age == "unknown", "age?"),
            F.when(salary_tag == "unknown", "salary?"),
            F.when(loc_tag == "unknown", "loc?"),
        )
    )


