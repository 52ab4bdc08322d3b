"""Ranks, top-N selections and score calibration.

Top-N per group is ``row_number() <= n``: Spark prunes every input partition
to its own first n rows per group before the shuffle, so a group holding most
of the rows still sends only n rows per task.

A full rank has no such bound. It is built from counts instead of one sort of
the group: rows are counted per (group, score, block of order numbers), the
counts are summed up in order, and only within one block, which holds at most
``BLOCK`` rows because order numbers are unique, are rows sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import tenths
from ..functions.gates import scorer_eligible
from ..session import checkpoint, small

BLOCK_BITS = 16


def top_n(df: DataFrame, n: int, by: list[str], score: str = "score", order: str = "posting_id") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(order))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_n(df: DataFrame, n: int, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def full_rank(
    df: DataFrame, by: list[str], score: str = "score", order: str = "posting_id", name: str = "rank"
) -> DataFrame:
    """Exact rank of every row by score descending, then order number ascending.

    ``order`` is a unique whole number; scores have one decimal, so a group has
    under a thousand of them.
    """
    # Several passes follow: they read the scored rows from reliable storage
    # instead of scoring again. Pass the columns that are needed, not the text.
    keyed = checkpoint(df.withColumn("_b", F.shiftright(F.col(order), BLOCK_BITS)))
    counts = keyed.groupBy(*by, score, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_score = counts.groupBy(*by, score).agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    per_score = per_score.withColumn("_above", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*by, score).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n")
    offsets = offsets.join(per_score, [*by, score])
    offsets = offsets.select(*by, score, "_b", (F.col("_above") + F.col("_earlier")).alias("_off"))
    local = Window.partitionBy(*by, score, "_b").orderBy(order)
    placed = keyed.withColumn("_r", F.row_number().over(local)).join(offsets, [*by, score, "_b"])
    return placed.withColumn(name, F.col("_off") + F.col("_r")).drop("_b", "_r", "_off")


def page_of(rank: Column, size: int = 10) -> Column:
    return F.floor((rank - 1) / size).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 25, "medium").when(score >= 5, "low").otherwise("none")


def score_counts(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Histogram of the one-decimal scores: at most 951 rows per group, whatever the input."""
    return df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"))


def flat_groups(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Per group: row count, spread of the top tenth, and whether the scores are flat.

    Read off the histogram: the lowest score of the top tenth is the first one
    whose running count reaches its size.
    """
    hist = score_counts(df, by, score)
    down = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns(
        {"_run": F.sum("n").over(down), "total": F.sum("n").over(Window.partitionBy(*by))}
    )
    top = F.least(F.greatest(F.lit(3), F.floor(F.col("total") / 10)), F.col("total"))
    out = hist.groupBy(*by).agg(
        F.max("total").alias("n_rows"),
        F.max(score).alias("high"),
        F.min(score).alias("low"),
        F.max(F.when(F.col("_run") >= top, F.col(score))).alias("edge"),
    )
    spread = F.col("high") - F.col("edge")
    return out.select(
        *by, "n_rows", "low", "high", spread.alias("top_spread"),
        ((F.col("n_rows") >= 15) & (spread < 5.0)).alias("is_flat"),
    )


def stretch(df: DataFrame, by: list[str], score: str = "score", normalize: bool = True) -> DataFrame:
    """Spread the scores of flat groups over [5, 100]; other groups keep theirs."""
    df = checkpoint(df)
    wide = df.join(small(checkpoint(flat_groups(df, by, score))), by)
    room = F.col("high") - F.col("low")
    spread = tenths(5.0 + (F.col(score) - F.col("low")) / room * 95.0)
    flat = F.col("is_flat") & F.lit(normalize) & (room >= 1e-9)
    return wide.withColumn(score, F.when(flat, spread).otherwise(F.col(score))).drop(
        "n_rows", "low", "high", "top_spread"
    )


def override(df: DataFrame, scores: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """Replace the heuristic score by the newest external one of eligible rows, or of the top ``n`` of them.

    ``scores`` holds ``by`` + ``posting_id``, ``external_score``, ``external_reasons`` (and
    ``landed_at``, if a row can have several). Re-ranking on the new score is up to the caller.
    """
    keys = [*by, "posting_id"]
    eligible = scorer_eligible(F.col("data_quality"), F.col("description"))
    order = ["landed_at"] if "landed_at" in scores.columns else []
    newest = scores.groupBy(*keys).agg(F.max(F.struct(*order, "external_score", "external_reasons")).alias("_x"))
    if n is None:
        out = df.join(newest, keys, "left").withColumn("_x", F.when(eligible, F.col("_x")))
    else:
        narrow = checkpoint(df.filter(eligible).select(*keys, "score"))
        out = df.join(top_n(narrow, n, by).select(*keys).join(newest, keys), keys, "left")
    has = F.col("_x.external_score").isNotNull()
    return out.withColumns(
        {
            "score": F.when(has, F.col("_x.external_score")).otherwise(F.col("score")),
            "reasons": F.when(has, F.coalesce("_x.external_reasons", F.array().cast("array<string>"))).otherwise(F.col("reasons")),
            "overridden": has,
        }
    ).drop("_x")

