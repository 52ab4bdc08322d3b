"""Queries that match many profiles, and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import tracking
from ..plans import many
from ..sinks import documents
from . import shapes
from .filtering import sql_has_skill, word_bounded
from .normalizing import NORMALIZED, normalized, sql_title_level, sql_years_level
from .ranking import SCORED, scored, sql_tenths
from .registry import query
from .shapes import AS_OF, PROFILES, as_of, sql_list, with_
from .tracking import SIGHTINGS, history

_BODY = "lower(title || ' ' || description)"
_STOP = sql_list(fixed.TITLE_STOP_WORDS)
_POOL = shapes.SKILL_POOL
_LEVELS = "['entry', 'mid', 'senior', 'staff']"


def _list(test) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test(s)} THEN '{s}' END" for s in _POOL) + "], lambda x: x IS NOT NULL)"


@query(
    "best_for_many_profiles",
    with_(
        NORMALIZED, PROFILES,
        f"""post AS (SELECT posting_id, {_list(lambda s: f"regexp_matches({_BODY}, '{word_bounded(s)}')")} AS found,
            {_list(lambda s: sql_has_skill(_BODY, s))} AS must_found,
            list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9+#.]+')), lambda x: NOT list_contains({_STOP}, x)) AS tt,
            {sql_title_level('title')} AS level, lower(trim(location)) AS place, remote_ok, lower(workplace_type) AS kind,
            CASE lower(COALESCE(data_quality, '')) WHEN 'full' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.85::DOUBLE
              ELSE CASE WHEN length(trim(description)) >= 30 THEN 1.0::DOUBLE WHEN length(trim(description)) >= 8 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END END AS sure,
            CASE WHEN listed_epoch IS NULL THEN 0.0 WHEN ({AS_OF} - listed_epoch) < 3 * 86400 THEN 5.0 WHEN ({AS_OF} - listed_epoch) < 7 * 86400 THEN 3.0
              WHEN ({AS_OF} - listed_epoch) < 14 * 86400 THEN 1.0 ELSE 0.0 END::DOUBLE AS rec FROM normalized),
          prof AS (SELECT profile_id, p_skills, p_must_have_skills, regexp_extract_all(lower(p_title || ' ' || p_headline), '[a-z0-9+#.]+') AS want,
            lower(trim(p_location)) AS pl, list_filter(regexp_extract_all(lower(p_location), '[a-z0-9+#.]+'), lambda t: length(t) > 2) AS pt,
            {sql_years_level('TRY_CAST(p_experience AS DOUBLE)')} AS pe, p_remote_preference AS pref FROM profiles),
          pair AS (SELECT profile_id, posting_id,
            CASE WHEN len(p_skills) > 0 THEN LEAST(1.0::DOUBLE, len(list_intersect(p_skills, found))::DOUBLE / LEAST(len(p_skills), 10)::DOUBLE) * 35.0::DOUBLE * sure ELSE 0.0 END::DOUBLE AS s1,
            CASE WHEN len(tt) > 0 THEN LEAST(1.0::DOUBLE, len(list_intersect(tt, want))::DOUBLE / len(tt)::DOUBLE) * 25.0::DOUBLE ELSE 0.0 END::DOUBLE AS s2,
            CASE WHEN pe IS NULL THEN 0.0 WHEN level IS NULL THEN 7.5 WHEN list_position({_LEVELS}, level) = list_position({_LEVELS}, pe) THEN 15.0
              WHEN abs(list_position({_LEVELS}, level) - list_position({_LEVELS}, pe)) = 1 THEN 7.5 ELSE 3.0 END::DOUBLE AS s3,
            CASE WHEN pl IN ('', 'remote') THEN CASE WHEN place = '' OR contains(place, 'remote') THEN 12.0 ELSE 10.0 END
              WHEN list_has_any(regexp_extract_all(place, '[a-z0-9+#.]+'), pt) THEN 15.0 WHEN contains(place, 'remote') THEN 12.0 ELSE 3.0 END::DOUBLE AS s4,
            CASE WHEN list_contains(p_skills, 'amazon web services') THEN CASE WHEN list_contains(found, 'amazon web services') THEN 10.0::DOUBLE * sure ELSE 0.0 END ELSE 0.0 END::DOUBLE AS s5,
            rec AS s6, CASE WHEN (pref IN ('remote', 'hybrid') AND (remote_ok OR contains(kind, 'remote') OR contains(kind, 'hybrid')))
              OR (pref = 'onsite' AND NOT remote_ok AND NOT contains(kind, 'remote')) THEN 3.0 ELSE 0.0 END::DOUBLE AS s7,
            LEAST(6.0::DOUBLE, 2.0::DOUBLE * len(list_intersect(p_must_have_skills, must_found))::DOUBLE) AS s8 FROM prof, post),
          total AS (SELECT profile_id, posting_id, GREATEST(5.0::DOUBLE, LEAST(100.0::DOUBLE, s1 + s2 + s3 + s4 + s5 + s6 + s7 + s8)) AS raw FROM pair),
          done AS (SELECT profile_id, posting_id, {sql_tenths('raw')} AS score FROM total)""",
        body="""SELECT profile_id, posting_id, score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, posting_id) AS rank
          FROM done QUALIFY rank <= 5""",
    ),
)
def best_for_many_profiles(spark, sf_dir):
    return many.top_matches(normalized(spark, sf_dir), shapes.profiles(spark, sf_dir), as_of(), 5)


@query(
    "watch_document",
    with_(SIGHTINGS, SCORED, """flagged AS (SELECT posting_id, url, url <> '' AND url IN (SELECT url FROM seen) AS is_seen FROM scored),
        batch AS (SELECT DISTINCT url FROM scored WHERE url <> '')""",
        body="""SELECT 'watch' AS command, 'devops' AS query, (SELECT count(*) FROM scored) AS found_count,
          (SELECT count(*) FROM flagged WHERE NOT is_seen) AS new_count, (SELECT count(*) FROM flagged WHERE is_seen) AS seen_count,
          (SELECT count(*) FROM (SELECT url FROM seen UNION SELECT url FROM batch)) AS seen_urls_total,
          (SELECT count(*) FROM batch WHERE url NOT IN (SELECT url FROM seen)) AS marked_seen"""),
)
def watch_document(spark, sf_dir):
    """Header of a watch run: its rows against the seen table, then the table after marking them."""
    from ..session import checkpoint

    rows = checkpoint(scored(spark, sf_dir).select("posting_id", "title", "company", "source", "url", "score"))
    seen = history(spark, sf_dir)
    after = tracking.upsert_seen(seen, rows.withColumn("seen_at", as_of()))
    run = rows.agg(F.count(F.lit(1)).alias("found_count")).select("found_count", F.lit("devops").alias("query"))
    head = documents.watch_header(run, tracking.with_seen(rows, seen), after)
    return head.select("command", "query", "found_count", "new_count", "seen_count", "seen_urls_total", "marked_seen")
