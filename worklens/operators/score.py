"""Relevance of a posting for a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, words
from ..functions.base import DAY, strip, tenths, text, within, words as literal
from .filters import ProfileColumns

SKILL_POINTS, TITLE_POINTS, KEYWORD_POINTS = 35.0, 25.0, 10.0
SOFT_CAP = 45.0


def confidence(quality: Column, description: Column) -> Column:
    q, n = F.lower(text(quality)), F.length(strip(text(description)))
    return (
        F.when(q == "full", 1.0).when(q == "partial", 0.85).when(q == "snippet", 0.7)
        .when(n >= 30, 1.0).when(n >= 8, 0.85).otherwise(0.7)
    )


LEVELS = ["entry", "mid", "senior", "staff"]


def _level_number(level: Column) -> Column:
    return F.array_position(literal(LEVELS), level)


def seniority(mine: Column, theirs: Column) -> tuple[Column, Column]:
    diff = _level_number(theirs) - _level_number(mine)
    points = (
        F.when(mine.isNull(), 0.0).when(theirs.isNull(), 7.5).when(diff == 0, 15.0)
        .when(F.abs(diff) == 1, 7.5).otherwise(3.0)
    )
    both = F.concat(F.lit(": profile="), mine, F.lit(", job="), theirs)
    reason = (
        F.when(mine.isNull(), F.lit(None).cast("string"))
        .when(theirs.isNull(), "Seniority not specified in title")
        .when(diff == 0, F.concat(F.lit("Seniority match: "), mine))
        .when(F.abs(diff) == 1, F.concat(F.lit("Seniority close"), both))
        .when(diff > 0, F.concat(F.lit("Job may be overqualified"), both))
        .otherwise(F.concat(F.lit("Job may be underqualified"), both))
    )
    return points, reason


def place(job: Column, want: Column, want_tokens: Column) -> tuple[Column, Column]:
    open_ended = (want == "") | (want == "remote")
    remote = F.contains(job, F.lit("remote"))
    shared = F.exists(
        F.array_intersect(words.tokenize(job), want_tokens), lambda t: F.length(t) > 2
    )
    points = (
        F.when(open_ended, F.when(remote | (job == ""), 12.0).otherwise(10.0))
        .when(shared, 15.0).when(remote, 12.0).otherwise(3.0)
    )
    reason = (
        F.when(open_ended, F.when(remote | (job == ""), "Remote work").otherwise("No location preference set"))
        .when(shared, "Location match").when(remote, "Remote position (location flexible)")
    )
    return points, reason


def recency(age: Column, epoch: Column, as_of: Column) -> tuple[Column, Column]:
    days = (as_of.cast("double") - epoch) / DAY
    unknown = F.coalesce(age == "unknown", F.lit(False)) | epoch.isNull()
    points = (
        F.when(unknown, 0.0).when(days < 3, 5.0).when(days < 7, 3.0).when(days < 14, 1.0).otherwise(0.0)
    )
    reason = (
        F.when(unknown, F.lit(None).cast("string")).when(days < 3, "Fresh posting")
        .when(days < 7, "Recent posting").when(days < 14, "Listed within 2 weeks")
    )
    return points, reason


def workplace(want: Column, remote_ok: Column, low: Column) -> tuple[Column, Column]:
    remote = F.coalesce(remote_ok, F.lit(False))
    flexible = remote | F.contains(low, F.lit("remote")) | F.contains(low, F.lit("hybrid"))
    reason = F.when(want.isin("remote", "hybrid") & flexible, "Remote-friendly workplace").when(
        (want == "onsite") & ~remote & ~F.contains(low, F.lit("remote")), "On-site position"
    )
    return F.when(reason.isNotNull(), 3.0).otherwise(0.0), reason


def _joined(values: Column, n: int) -> Column:
    return F.array_join(F.slice(values, 1, n), ", ")


def score(df: DataFrame, p: ProfileColumns, as_of: Column) -> DataFrame:
    """Add the parts, ``score`` and ``reasons``. Row-wise: no shuffle, batch or stream.

    The hit lists are columns of their own first, so each is computed once
    however many parts read it.
    """
    body = F.concat_ws(" ", F.col("title"), F.col("description"))
    df = df.withColumns(
        {
            "_confidence": confidence(F.col("data_quality"), F.col("description")),
            "_title": F.filter(words.tokenize(F.col("title")), lambda t: ~within(t, fixed.TITLE_STOP_WORDS)),
            "_skills": words.hits(body, p.skill_needles),
            "_phrase_hits": F.when(
                F.size(p.phrase_needles) > 0, F.size(words.hits(body, p.phrase_needles))
            ),
            "_must": words.hits(body, p.must_needles),
            "_level": words.level_from_title(F.col("title")),
            "_place": F.lower(strip(text(F.col("location")))),
            "_kind": F.lower(F.concat_ws(" ", F.col("workplace_type"), F.col("workplace"))),
        }
    )
    df = df.withColumn("_shared", F.array_intersect(F.col("_title"), p.title_tokens))
    n, n_phrases = F.size(p.skill_needles), F.size(p.phrase_needles)
    sure = F.col("_confidence")
    skills = F.when(
        n > 0,
        F.least(F.lit(1.0), F.size("_skills") / F.greatest(F.lit(1), F.least(n, F.lit(10)))) * SKILL_POINTS * sure,
    ).otherwise(0.0)
    title = F.when(
        (F.size(p.title_tokens) > 0) & (F.size("_title") > 0),
        F.least(F.lit(1.0), F.size("_shared") / F.size("_title")) * TITLE_POINTS,
    ).otherwise(0.0)
    keywords = F.when(
        n_phrases > 0, F.col("_phrase_hits") / n_phrases * KEYWORD_POINTS * sure
    ).otherwise(0.0)
    level, level_reason = seniority(p.level, F.col("_level"))
    where, where_reason = place(F.col("_place"), p.place, p.place_tokens)
    fresh, fresh_reason = recency(F.col("age"), F.col("listed_epoch"), as_of)
    work, work_reason = workplace(
        p.preference, F.col("remote_ok"), F.col("_kind")
    )
    must = F.least(F.lit(6.0), 2.0 * F.size("_must"))
    df = df.withColumns(
        {
            "skill_points": skills, "title_points": title, "seniority_points": level,
            "location_points": where, "keyword_points": keywords, "recency_points": fresh,
            "workplace_points": work, "must_points": must,
        }
    )
    total = (
        F.col("skill_points") + F.col("title_points") + F.col("seniority_points") + F.col("location_points")
        + F.col("keyword_points") + F.col("recency_points") + F.col("workplace_points") + F.col("must_points")
    )
    soft = F.coalesce(F.col("must_skills_soft"), F.lit(False))
    capped = F.when(soft, F.least(total, F.lit(SOFT_CAP))).otherwise(total)
    df = df.withColumn("raw_score", F.greatest(F.lit(5.0), F.least(capped, F.lit(100.0))))
    found = F.size("_skills")
    reasons = F.array_compact(
        F.array(
            F.when(
                found > 0,
                F.concat(
                    F.lit("Skills: "), _joined(F.col("_skills"), 5),
                    F.when(found > 5, F.concat(F.lit(" +"), (found - 5).cast("string"), F.lit(" more"))).otherwise(""),
                ),
            ),
            F.when(
                F.size("_shared") > 0,
                F.concat(F.lit("Title overlap: "), _joined(F.array_sort("_shared"), 5)),
            ),
            level_reason, where_reason, fresh_reason, work_reason,
            F.when(F.size("_must") > 0, F.concat(F.lit("Must-have skill: "), _joined(F.col("_must"), 3))),
            F.when(soft, "Below must-skill threshold (soft mode)"),
        )
    )
    low = F.array(F.lit("Low match — few overlapping signals"))
    return df.withColumns(
        {
            "score": tenths(F.col("raw_score")),
            "reasons": F.slice(F.when(F.col("raw_score") < 10, low).otherwise(reasons), 1, 8),
        }
    ).drop(
        "_confidence", "_title", "_skills", "_shared", "_phrase_hits", "_must", "_level", "_place", "_kind"
    )


POINTS = [
    "skill_points", "title_points", "seniority_points", "location_points", "keyword_points",
    "recency_points", "workplace_points", "must_points",
]

