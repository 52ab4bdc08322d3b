"""The search plan: normalize, filter, score and rank postings for one profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters, rank, score
from ..operators.filters import FilterOptions, Profile, ProfileColumns
from ..operators.normalize import conform, normalize


def marked(
    postings: DataFrame, profile: Profile, options: FilterOptions, as_of: Column, bound: ProfileColumns | None = None
) -> DataFrame:
    """Normalized postings with their filter marks: the base of the rows and of the report."""
    bound = bound or profile.columns(postings.sparkSession)
    return filters.mark_stages(normalize(conform(postings), as_of), bound, options, as_of)


def scored(postings: DataFrame, profile: Profile, options: FilterOptions, as_of: Column) -> DataFrame:
    """Kept postings with score and reasons. Row-wise end to end, batch or stream."""
    bound = profile.columns(postings.sparkSession)
    rows = filters.kept(marked(postings, profile, options, as_of, bound))
    return score.score(rows, bound, as_of)


def top_postings(
    postings: DataFrame, profile: Profile, options: FilterOptions, as_of: Column, n: int = 10
) -> DataFrame:
    """Best n postings. One profile needs no window: the sort-and-limit keeps n rows per task."""
    best = scored(postings, profile, options, as_of).orderBy(F.desc("score"), "posting_id").limit(n)
    return rank.top_n(best.withColumn("profile_id", F.lit(0)), n, ["profile_id"]).drop("profile_id")
