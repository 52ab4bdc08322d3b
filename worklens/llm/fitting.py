"""A bounded sample of labelled rows, the only thing a classifier here gathers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier learns from at most: those of smallest hashed id.
SAMPLE = 20_000


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)).cast("int")


def sampled_labels(labels: DataFrame, name: str, modulus: int, held: int, sample: int) -> DataFrame:
    """(doc_id, y) of at most ``sample`` labelled documents outside the held-out fold; of repeated labels the commoner."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & (remainder(modulus) != held))
    rows = rows.groupBy("doc_id").agg((F.avg(F.col(name)) >= 0.5).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def labelled(docs: DataFrame, labels: DataFrame, name: str, modulus: int, held: int, sample: int) -> DataFrame:
    """(doc_id, text, y) of the sampled documents. The sample bounds the broadcast side to 16 bytes a row."""
    return docs.select("doc_id", "text").join(F.broadcast(sampled_labels(labels, name, modulus, held, sample)), "doc_id")
