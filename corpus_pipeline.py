"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on
all rows that its predecessor kept, and all but the last return the columns of
``documents``. ``run`` writes every stage's result as Parquet into the shared
folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm import decontaminate, near_dedup, packing, quality, secrets
from worklens.session import checkpoint, shared_folder, ship, small


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not in ``ids``; rows without an id stay."""
    gone = small(checkpoint(ids.select(F.col("doc_id").alias("_gone")).distinct()))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality model keeps (a score of 0.3 or more).

    NULL and empty texts are scored as what they are; rows without an id, and repeated ones, are judged one by one; no documents give none.
    """
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): its smallest doc_id.

    Of rows that repeat a doc_id one stays; documents without words, or without an id, stay.
    """
    found = checkpoint(near_dedup.near_duplicates(docs))
    unique = _without(docs, found.where(~F.col("kept")))
    repeated = checkpoint(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1"))
    if repeated.isEmpty():
        return unique
    twice = unique.join(repeated.select("doc_id"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return _without(unique, repeated).unionByName(twice)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; items of under five words occur by chance, so they condemn no document.

    Documents that are NULL or empty, or have no id, stay; repeated rows go or stay together.
    """
    return _without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=5))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask; ``n_chars`` follows the text.

    NULL texts stay NULL and empty ones empty; rows without an id and repeated rows are masked one by one; all columns stay.
    """
    hidden = secrets.redacted(docs)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: bin_id, capacity, n_tokens, and the pieces in it by place (doc_ids, starts, lengths).

    NULL and empty texts are their end token alone; repeated rows, and those without an id, are packed one by one; no documents give no sequences.
    """
    pieces = packing.packed(packing.word_counts(docs))
    # A bin holds no more pieces than tokens, at most the largest capacity.
    bins = pieces.groupBy("bin_id", "capacity").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "doc_id", "start", "n_tokens"))).alias("p"))
    return bins.select("bin_id", "capacity", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.n_tokens").alias("lengths"))


STAGES = [
    ("quality", good_quality), ("near_dedup", one_of_each), ("decontaminate", without_benchmark), ("secrets", without_secrets), ("packing", in_sequences),
]

#: SQL can't express the quality model or the packing; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
