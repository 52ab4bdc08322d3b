"""Queries of the score, its parts, the ranks and the score calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import rank, score
from ..plans import search
from . import shapes
from .filtering import CANDIDATE, MARKED, OPTIONS, sql_has_skill, word_bounded
from .normalizing import sql_title_level
from .registry import query
from .shapes import AS_OF, as_of, sql_list, table, with_

# --- SQL of the check ---------------------------------------------------------

_SKILLS = list(CANDIDATE.skills)
_BODY = "lower(title || ' ' || description)"


def _hit(skill: str) -> str:
    return f"CAST(regexp_matches({_BODY}, '{word_bounded(skill)}') AS INT)"


def sql_tenths(x: str) -> str:
    """One decimal, half to even on the exact binary value."""
    s, err = f"({x} * 16.0 + {x} * 4.0)", None
    bb = f"({s} - {x} * 16.0)"
    err = f"(({x} * 16.0 - ({s} - {bb})) + ({x} * 4.0 - {bb}))"
    k = f"floor({x} * 10.0)"
    d = f"({s} - ({k} * 2.0 + 1.0))"
    return (
        f"(CASE WHEN {d} > 0 OR ({d} = 0 AND {err} > 0) OR ({d} = 0 AND {err} = 0 AND {k}::BIGINT % 2 = 1) "
        f"THEN {k} + 1.0 ELSE {k} END) / 10.0"
    )


_STOP = sql_list(fixed.TITLE_STOP_WORDS)
_MUST = list(CANDIDATE.must_have_skills)
SCORED = MARKED + ",\n" + f"""base AS (
  SELECT t.*, [{', '.join(f"CASE WHEN {_hit(s)} = 1 THEN '{s}' END" for s in _SKILLS)}] AS skill_list,
    [{', '.join(f"CASE WHEN {sql_has_skill(_BODY, s)} THEN '{s}' END" for s in _MUST)}] AS must_list,
    list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9+#.]+')),
      lambda x: NOT list_contains({_STOP}, x)) AS title_tokens,
    {sql_title_level('title')} AS level, lower(trim(location)) AS place,
    CASE lower(COALESCE(data_quality, '')) WHEN 'full' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.85::DOUBLE WHEN 'snippet' THEN 0.7::DOUBLE
      ELSE CASE WHEN length(trim(description)) >= 30 THEN 1.0::DOUBLE WHEN length(trim(description)) >= 8 THEN 0.85::DOUBLE
        ELSE 0.7::DOUBLE END END AS sure,
    ({AS_OF} - listed_epoch) / 86400.0::DOUBLE AS days_old
  FROM tagged t WHERE drop_stage = 0),
listed AS (
  SELECT *, list_filter(skill_list, lambda x: x IS NOT NULL) AS found, list_filter(must_list, lambda x: x IS NOT NULL) AS must,
    list_sort(list_intersect(title_tokens, ['platform', 'engineer', 'devops'])) AS shared,
    len(list_filter(list_distinct(regexp_extract_all(place, '[a-z0-9+#.]+')),
      lambda x: list_contains(['pune', 'bengaluru'], x))) > 0 AS near
  FROM base),
parts AS (
  SELECT *,
    LEAST(1.0::DOUBLE, len(found)::DOUBLE / {min(len(_SKILLS), 10)}::DOUBLE) * 35.0::DOUBLE * sure AS skill_points,
    CASE WHEN len(title_tokens) > 0 THEN LEAST(1.0::DOUBLE, len(shared)::DOUBLE / len(title_tokens)::DOUBLE) * 25.0::DOUBLE
      ELSE 0.0::DOUBLE END AS title_points,
    CASE level WHEN 'mid' THEN 15.0::DOUBLE WHEN 'entry' THEN 7.5::DOUBLE WHEN 'senior' THEN 7.5::DOUBLE ELSE 7.5::DOUBLE END AS seniority_points,
    CASE WHEN near THEN 15.0::DOUBLE WHEN contains(place, 'remote') THEN 12.0::DOUBLE ELSE 3.0::DOUBLE END AS location_points,
    CAST(list_contains(found, 'amazon web services') AS INT)::DOUBLE / 1.0::DOUBLE * 10.0::DOUBLE * sure AS keyword_points,
    CASE WHEN listed_epoch IS NULL THEN 0.0::DOUBLE WHEN days_old < 3 THEN 5.0::DOUBLE WHEN days_old < 7 THEN 3.0::DOUBLE
      WHEN days_old < 14 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recency_points,
    0.0::DOUBLE AS workplace_points, LEAST(6.0::DOUBLE, 2.0::DOUBLE * len(must)::DOUBLE) AS must_points
  FROM listed),
totals AS (
  SELECT *, GREATEST(5.0::DOUBLE, LEAST(skill_points + title_points + seniority_points + location_points + keyword_points
    + recency_points + workplace_points + must_points, 100.0::DOUBLE)) AS raw_score FROM parts),
scored AS (
  SELECT *, {sql_tenths('raw_score')} AS score, list_filter([
    CASE WHEN len(found) > 0 THEN 'Skills: ' || array_to_string(found[1:5], ', ')
      || CASE WHEN len(found) > 5 THEN ' +' || (len(found) - 5) || ' more' ELSE '' END END,
    CASE WHEN len(shared) > 0 THEN 'Title overlap: ' || array_to_string(shared[1:5], ', ') END,
    CASE WHEN level IS NULL THEN 'Seniority not specified in title' WHEN level = 'mid' THEN 'Seniority match: mid'
      ELSE 'Seniority close: profile=mid, job=' || level END,
    CASE WHEN near THEN 'Location match' WHEN contains(place, 'remote') THEN 'Remote position (location flexible)' END,
    CASE WHEN days_old < 3 THEN 'Fresh posting' WHEN days_old < 7 THEN 'Recent posting' WHEN days_old < 14 THEN 'Listed within 2 weeks' END,
    CASE WHEN len(must) > 0 THEN 'Must-have skill: ' || array_to_string(must[1:3], ', ') END], lambda x: x IS NOT NULL) AS reasons
  FROM totals),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, posting_id) AS rank FROM scored)"""


def scored(spark, sf_dir):
    return search.scored(shapes.postings(spark, sf_dir), CANDIDATE, OPTIONS, as_of()).withColumn("profile_id", F.lit(1))


def all_scored(spark, sf_dir):
    """Scores without the filter: every posting of the table."""
    bound = CANDIDATE.columns(spark)
    rows = search.marked(shapes.postings(spark, sf_dir), CANDIDATE, OPTIONS, as_of(), bound)
    return score.score(rows, bound, as_of()).withColumn("profile_id", F.col("posting_id") % 4)


ALL_SCORED = SCORED.replace("FROM tagged t WHERE drop_stage = 0", "FROM tagged t")

# --- queries ------------------------------------------------------------------


@query(
    "top_postings",
    with_(SCORED, body="""SELECT rank, posting_id, title, company, location, url, source, score,
      array_to_string(reasons, '; ') AS reasons FROM ranked WHERE rank <= 10"""),
)
def top_postings(spark, sf_dir):
    best = search.top_postings(shapes.postings(spark, sf_dir), CANDIDATE, OPTIONS, as_of(), 10)
    return best.select(
        "rank", "posting_id", "title", "company", "location", "url", "source", "score",
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query(
    "score_parts",
    with_(ALL_SCORED, body=f"SELECT posting_id, {', '.join(f'round({p}, 6) AS {p}' for p in score.POINTS)}, score FROM scored"),
)
def score_parts(spark, sf_dir):
    return all_scored(spark, sf_dir).select(
        "posting_id", *[F.round(p, 6).alias(p) for p in score.POINTS], "score"
    )


@query("score_reasons", with_(ALL_SCORED, body="SELECT posting_id, score, array_to_string(reasons, '; ') AS reasons FROM scored"))
def score_reasons(spark, sf_dir):
    return all_scored(spark, sf_dir).select("posting_id", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "full_ranking",
    with_(ALL_SCORED, body="""SELECT posting_id % 4 AS profile_id, posting_id, score,
      row_number() OVER (PARTITION BY posting_id % 4 ORDER BY score DESC, posting_id) AS rank FROM scored"""),
)
def full_ranking(spark, sf_dir):
    rows = all_scored(spark, sf_dir).select("profile_id", "posting_id", "score")
    return rank.full_rank(rows, ["profile_id"])


_ELIGIBLE = "(COALESCE(data_quality, '') IN ('full', 'partial') OR length(trim(description)) >= 60)"


@query(
    "top_for_scorer",
    with_(ALL_SCORED, body=f"""SELECT * FROM (SELECT posting_id % 4 AS profile_id, posting_id, score,
      row_number() OVER (PARTITION BY posting_id % 4 ORDER BY score DESC, posting_id) AS rank
      FROM scored WHERE {_ELIGIBLE}) WHERE rank <= 30"""),
)
def top_for_scorer(spark, sf_dir):
    from ..functions.gates import scorer_eligible

    rows = all_scored(spark, sf_dir).filter(scorer_eligible(F.col("data_quality"), F.col("description")))
    return rank.top_n(rows.select("profile_id", "posting_id", "score"), 30, ["profile_id"])


@query(
    "score_bands_and_pages",
    with_(ALL_SCORED, body="""SELECT posting_id, rank, (rank - 1) // 10 AS page,
      CASE WHEN score >= 60 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score >= 5 THEN 'low' ELSE 'none' END AS band
      FROM ranked"""),
)
def score_bands_and_pages(spark, sf_dir):
    rows = all_scored(spark, sf_dir).select(F.lit(1).alias("profile_id"), "posting_id", "score")
    r = rank.full_rank(rows, ["profile_id"])
    return r.select("posting_id", "rank", rank.page_of(F.col("rank")).alias("page"), rank.band(F.col("score")).alias("band"))


_FLAT = """grouped AS (SELECT posting_id, posting_id % 60 AS profile_id, score FROM scored),
top AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC) AS r,
    count(*) OVER (PARTITION BY profile_id) AS n FROM grouped),
facts AS (SELECT profile_id, max(n) AS n_rows, min(score) AS low, max(score) AS high,
    max(score) - min(score) FILTER (r <= GREATEST(3, n // 10)) AS top_spread,
    max(n) >= 15 AND max(score) - min(score) FILTER (r <= GREATEST(3, n // 10)) < 5 AS is_flat FROM top GROUP BY profile_id)"""


@query(
    "flat_score_guard",
    with_(ALL_SCORED, _FLAT, body="SELECT profile_id, n_rows, low, high, round(top_spread, 6) AS top_spread, is_flat FROM facts"),
)
def flat_score_guard(spark, sf_dir):
    rows = all_scored(spark, sf_dir).withColumn("profile_id", F.col("posting_id") % 60)
    return rank.flat_groups(rows.select("profile_id", "score"), ["profile_id"]).withColumn(
        "top_spread", F.round("top_spread", 6)
    )


@query(
    "score_stretch",
    with_(ALL_SCORED, _FLAT, body=f"""SELECT posting_id, profile_id, is_flat, CASE WHEN is_flat AND high - low >= 1e-9 THEN
      {sql_tenths('(5.0::DOUBLE + (score - low) / (high - low) * 95.0::DOUBLE)')} ELSE score END AS score
      FROM grouped JOIN facts USING (profile_id)"""),
)
def score_stretch(spark, sf_dir):
    rows = all_scored(spark, sf_dir).withColumn("profile_id", F.col("posting_id") % 60)
    return rank.stretch(rows.select("posting_id", "profile_id", "score"), ["profile_id"])


def external_scores(spark, sf_dir):
    """An external score for a share of the postings, from the labels."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        (k % 4).alias("profile_id"), k.alias("posting_id"),
        (F.col("quality") * 40 + k % 50).cast("double").alias("external_score"),
        F.array(F.lit("external")).alias("external_reasons"),
    )


@query(
    "scorer_override",
    with_(ALL_SCORED, f"""chosen AS (SELECT posting_id FROM scored WHERE {_ELIGIBLE}),
      ext AS (SELECT doc_id AS posting_id, (quality * 40 + doc_id % 50)::DOUBLE AS external_score FROM labels JOIN chosen ON doc_id = posting_id),
      merged AS (SELECT s.posting_id, s.posting_id % 4 AS profile_id, COALESCE(e.external_score, s.score) AS score,
        e.external_score IS NOT NULL AS overridden FROM scored s LEFT JOIN ext e USING (posting_id))""",
        body="""SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, posting_id) AS rank FROM merged"""),
)
def scorer_override(spark, sf_dir):
    rows = all_scored(spark, sf_dir).select(
        "profile_id", "posting_id", "score", "reasons", "data_quality", "description"
    )
    done = rank.override(rows, external_scores(spark, sf_dir), ["profile_id"])
    return rank.full_rank(done.select("profile_id", "posting_id", "score", "overridden"), ["profile_id"])
