"""Queries of the gates, the five-stage filter, its report and the tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, gates, times, urls, words
from ..operators import filters, normalize as norm
from ..operators.filters import FilterOptions, Profile, ProfileColumns
from . import shapes
from .normalizing import NORMALIZED, normalized, q
from .registry import query
from .shapes import AS_OF, PAIRS, PROFILES, as_of, pick, sql_list, sql_pick, table, with_

CANDIDATE = Profile(
    title="Platform Engineer", headline="DevOps Engineer", location="Pune, Bengaluru", experience="4",
    remote_preference="", min_salary=10,
    skills=("aws", "docker", "kubernetes", "terraform", "ci/cd", "linux", "amazon web services", "c++"),
    must_have_skills=("kubernetes", "aws"),
)
OPTIONS = FilterOptions(days=30)

# --- SQL of the check ---------------------------------------------------------


def bounded(skill: str) -> str:
    """Edge rule as a pattern without look-around."""
    import re

    return "(^|[^a-z0-9])" + re.escape(skill).replace("\\ ", " ").replace("/", "/") + "([^a-z0-9]|$)"


def word_bounded(skill: str) -> str:
    import re

    tail = "([^a-z0-9_]|$)" if re.match(r"\w", skill[-1]) else "[a-z0-9_]"
    return "(^|[^a-z0-9_])" + re.escape(skill).replace("\\ ", " ") + tail


def sql_variants(skill: str) -> list[str]:
    return fixed.SKILL_VARIANTS.get(skill, [skill])


def sql_has_skill(body: str, skill: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({body}, '{bounded(v)}')" for v in sql_variants(skill)) + ")"


_JUNK = fixed.JUNK_TITLE
_PLACE = sql_list(fixed.PLACEHOLDERS)


def sql_junk(title: str) -> str:
    low = f"lower(trim({title}))"
    return (
        f"(regexp_matches({low}, '{_JUNK}') OR regexp_matches({low}, '{fixed.URL_IN_TITLE}') OR "
        f"(length({low}) - length(replace({low}, ',', '')) >= 3 AND "
        f"NOT regexp_matches({low}, '{fixed.FRAGMENT_ROLE_WORDS}')))"
    )


def sql_stage(days: int = 30, min_salary: str = "10", hits: str = "hits", cities: str = "['Pune', 'Bengaluru']",
              regions: str = "['Maharashtra', 'Karnataka']", pref: str = "''", strict: bool = False) -> str:
    return f"""CASE
      WHEN trim(title) = '' OR {sql_junk('title')}
        OR ((list_contains({_PLACE}, lower(trim(title))) OR starts_with(lower(trim(title)), 'naukri'))
            AND list_contains({_PLACE}, lower(trim(company))))
        OR (lower(trim(title)) = lower(trim(company)) AND NOT contains(trim(title), ' '))
        OR trim(url) = '' OR (regexp_matches(url, 'rc/clk|pagead/clk', 'i') AND COALESCE(job_key, '') = '') THEN 1
      WHEN listed_epoch < {AS_OF} - {days} * 86400 {'OR listed_epoch IS NULL' if strict else ''} THEN 2
      WHEN {hits} IS NOT NULL AND {hits} < 1 THEN 3
      WHEN CASE
        WHEN remote_ok THEN NOT (list_contains(['remote', 'hybrid'], {pref}) OR len({cities}) = 0
                                 OR list_contains({cities}, 'Remote'))
        WHEN len({cities}) = 0 THEN false
        WHEN list_contains({cities}, 'India') AND city <> '' THEN false
        WHEN list_contains({cities}, city) THEN false
        WHEN city <> '' AND region <> '' AND list_contains({regions}, region) THEN false
        WHEN city = '' THEN {'true' if strict else 'false'} ELSE true END THEN 4
      WHEN {min_salary} > 0 AND salary_int < {min_salary} THEN 5
      ELSE 0 END"""


_BODY = "lower(title || ' ' || description)"
MARKED = NORMALIZED + ",\n" + f"""hit AS (
  SELECT *, ({' + '.join('CAST(' + sql_has_skill(_BODY, s) + ' AS INT)' for s in CANDIDATE.must_have_skills)}) AS hits
  FROM normalized),
marked AS (
  SELECT *, {sql_stage()} AS drop_stage FROM hit),
tagged AS (
  SELECT * REPLACE (CASE WHEN (drop_stage = 0 OR drop_stage >= 2) AND list_contains({_PLACE}, lower(trim(company)))
      THEN COALESCE(data_quality, 'partial') ELSE data_quality END AS data_quality),
    CASE WHEN (drop_stage = 0 OR drop_stage >= 2) AND listed_epoch IS NULL THEN 'unknown' END AS age,
    CASE WHEN (drop_stage = 0 OR drop_stage >= 4) AND NOT remote_ok AND city = '' THEN 'unknown' END AS loc_tag,
    CASE WHEN (drop_stage = 0 OR drop_stage >= 5) AND salary_int IS NULL THEN 'unknown' END AS salary_tag
  FROM marked)"""


def marked(spark, sf_dir, options=OPTIONS):
    return filters.mark_stages(normalized(spark, sf_dir), CANDIDATE.columns(spark), options, as_of())


# --- queries ------------------------------------------------------------------


@query("filter_stages", with_(MARKED, body="SELECT posting_id, drop_stage, age, loc_tag, salary_tag, data_quality FROM tagged"))
def filter_stages(spark, sf_dir):
    return marked(spark, sf_dir).select("posting_id", "drop_stage", "age", "loc_tag", "salary_tag", "data_quality")


_STAGE_ROWS = "stages(stage, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(filters.STAGES, 1)) + ")"
_NOTE = "' remote job(s) excluded — set filters.remote: true or profile remote_preference: remote/hybrid to include them'"
REPORTED = MARKED + ",\n" + _STAGE_ROWS + f""",
reported AS (
  SELECT stage, name,
    count(*) FILTER (drop_stage = 0 OR drop_stage > stage) AS kept,
    count(*) FILTER (drop_stage = stage) AS dropped,
    CASE stage WHEN 2 THEN count(*) FILTER (age = 'unknown') WHEN 5 THEN count(*) FILTER (salary_tag = 'unknown')
      ELSE 0 END AS unknown,
    CASE WHEN stage = 4 AND count(*) FILTER (drop_stage = 4 AND remote_ok) > 0
      THEN count(*) FILTER (drop_stage = 4 AND remote_ok) || {_NOTE} ELSE '' END AS reason
  FROM stages, tagged GROUP BY stage, name)"""


@query("filter_report", with_(REPORTED, body="SELECT stage, name, kept, dropped, unknown, reason FROM reported"))
def filter_report(spark, sf_dir):
    return filters.report(marked(spark, sf_dir))


@query(
    "filter_summary",
    with_(REPORTED, body="""SELECT
      string_agg(CASE WHEN dropped > 0 OR unknown > 0 THEN
        concat_ws(' · ', CASE WHEN dropped > 0 THEN name || ' −' || dropped END,
          CASE WHEN unknown > 0 THEN name || ' ?' || unknown END) END, ' · ' ORDER BY stage) AS filter_summary,
      max(CASE WHEN stage = 4 THEN reason END) AS filter_note FROM reported"""),
)
def filter_summary(spark, sf_dir):
    return filters.summary(filters.report(marked(spark, sf_dir)))


#: Per-profile location decision over the many-profile form of the filter.
_CITY_LIST = {
    "Pune": ["Pune"], "Hyderabad, Bengaluru": ["Hyderabad", "Bengaluru"], "India": ["India"], "Remote": ["Remote"],
    "": [], "Mumbai and Pune": ["Mumbai", "Pune"], "Noida / Delhi": ["Noida", "Delhi"], "San Francisco": ["San Francisco"],
}
_REGION_LIST = {
    "Pune": ["Maharashtra"], "Hyderabad, Bengaluru": ["Telangana", "Karnataka"], "India": [], "Remote": ["Remote"],
    "": [], "Mumbai and Pune": ["Maharashtra"], "Noida / Delhi": ["Delhi NCR"], "San Francisco": [],
}
_PREFS = "prefs(place, cities, regions) AS (VALUES " + ", ".join(
    f"({q(k)}, {sql_list(v)}::VARCHAR[], {sql_list(_REGION_LIST[k])}::VARCHAR[])" for k, v in _CITY_LIST.items()
) + ")"


@query(
    "filter_report_by_profile",
    with_(
        NORMALIZED, PROFILES, PAIRS, _PREFS, _STAGE_ROWS,
        f"""paired AS (
          SELECT n.*, pairs.profile_id, f.p_min_salary, f.p_remote_preference AS pref, s.cities, s.regions,
            CASE WHEN len(f.p_must_have_skills) = 0 THEN NULL ELSE len(list_filter(f.p_must_have_skills, lambda x:
              CASE x {' '.join("WHEN " + q(s) + " THEN " + sql_has_skill(_BODY, s) for s in shapes.SKILL_POOL)}
              ELSE false END)) END AS hits
          FROM pairs JOIN normalized n USING (posting_id) JOIN profiles f USING (profile_id) JOIN prefs s ON s.place = f.p_location),
        staged AS (SELECT p_remote_preference_group, drop_stage, listed_epoch, salary_int, p_min_salary FROM (
          SELECT *, pref AS p_remote_preference_group,
            {sql_stage(30, 'p_min_salary', 'hits', 'cities', 'regions', 'pref')} AS drop_stage FROM paired))""",
        body="""SELECT p_remote_preference_group AS p_remote_preference, stage, name,
          count(*) FILTER (drop_stage = 0 OR drop_stage > stage) AS kept,
          count(*) FILTER (drop_stage = stage) AS dropped FROM stages, staged GROUP BY ALL""",
    ),
)
def filter_report_by_profile(spark, sf_dir):
    """Each posting is judged by profiles chosen by its number; one report per preference."""
    pairs = shapes.pairs(spark, sf_dir, normalized(spark, sf_dir), filters.prepare(shapes.profiles(spark, sf_dir)))
    judged = filters.mark_stages(pairs, ProfileColumns.of(), OPTIONS, as_of())
    return filters.report(judged, ["p_remote_preference"]).select(
        "p_remote_preference", "stage", "name", "kept", "dropped"
    )


STRICT = FilterOptions(days=14, strict_age=True, strict_location=True, drop_unknown_salary=True, soft_must_skills=True)


@query(
    "strict_and_soft_filter",
    with_(
        MARKED.replace(sql_stage(), sql_stage(14, "10", "NULL::INT", strict=True)),
        body="""SELECT posting_id, CASE WHEN drop_stage = 0 AND salary_int IS NULL THEN 5 ELSE drop_stage END AS drop_stage,
          (drop_stage = 0 OR drop_stage >= 4) AND hits < 1 AS must_skills_soft FROM marked""",
    ),
)
def strict_and_soft_filter(spark, sf_dir):
    return marked(spark, sf_dir, STRICT).select("posting_id", "drop_stage", "must_skills_soft")


@query(
    "provenance_tags",
    with_(MARKED, body="""SELECT posting_id, array_to_string(list_filter([data_quality,
      CASE WHEN age = 'unknown' THEN 'age?' END, CASE WHEN salary_tag = 'unknown' THEN 'salary?' END,
      CASE WHEN loc_tag = 'unknown' THEN 'loc?' END], lambda x: x IS NOT NULL), ' ') AS tags
      FROM tagged WHERE drop_stage = 0"""),
)
def provenance_tags(spark, sf_dir):
    rows = filters.kept(marked(spark, sf_dir))
    tags = norm.provenance_tags(F.col("data_quality"), F.col("age"), F.col("salary_tag"), F.col("loc_tag"))
    return rows.select("posting_id", F.array_join(tags, " ").alias("tags"))


HIT_TITLES = [
    "DevOps Engineer - LinkedIn", "12 Python jobs in Pune", "Top 10 skills to learn", "Sign in", "How to become an SRE",
    "Senior Platform Engineer at Acme | Job", "Page 3", "Careers", "Search results", "Acme is hiring Data Engineer in Pune",
    "Job Application for Staff Engineer", "Metabase", "Kubernetes Admin",
]
HIT_PATHS = [
    "", "/", "/jobs/12", "/search?q=x", "/auth/me", "/login", "/en", "/careers/devops-engineer",
    "/job-listings-devops-engineer-acme-pune-3-to-5-years-123456", "/python-jobs-in-pune", "/blog/x",
]
HIT_TAILS = [
    "", " Posted 3 days ago.", " updated 2 months ago", " posted: jan 5, 2024", " Date: December 30, 2023",
    " published 9 weeks ago", " posted 1 yr ago", " date: feb 2",
]


def hits(spark, sf_dir):
    """Web hits: title and path picked by key, host and body from the page."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    site = F.regexp_extract("url", r"^https?://[^/]+", 0)
    body = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")
    return p.select(
        "page_id", pick(HIT_TITLES, k).alias("title"), F.concat(site, pick(HIT_PATHS, k)).alias("href"),
        F.concat(body, pick(HIT_TAILS, k)).alias("body"),
    )


HITS = rf"""
hits AS (SELECT page_id, {sql_pick(HIT_TITLES, 'page_id')} AS title,
  regexp_extract(url, '^https?://[^/]+') || {sql_pick(HIT_PATHS, 'page_id')} AS href,
  regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') || {sql_pick(HIT_TAILS, 'page_id')} AS body
  FROM pages)"""


def sql_any(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {q(p)}, 'i')" for p in patterns) + ")"


SQL_SEARCH_PAGE = "(" + sql_any("title", fixed.SEARCH_PAGE_TITLES) + " OR regexp_matches(href, '/search\\?', 'i'))"
SQL_HOMEPAGE = r"regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/')"


def sql_relevant(title: str, tokens: list[str]) -> str:
    return (
        f"(len(list_filter({sql_list(tokens)}, lambda t: contains(lower({title}), t))) > 0 OR "
        f"regexp_matches({title}, '{fixed.RELEVANCE_ROLE_WORDS}', 'i'))"
    )


def sql_snippet_old(body: str, days: int) -> str:
    low = f"lower({body})"
    parts = []
    for lead in ("", r"(?:posted|published|updated)\s+"):
        for unit, width in (("(?:year|yr)s?", 365), ("months?", 30), ("weeks?", 7), ("days?", 1)):
            got = rf"regexp_extract({low}, '{lead}(\d+)\s+{unit}\s+ago', 1)"
            parts.append(f"COALESCE(TRY_CAST({got} AS BIGINT) * {width} > {days}, false)")
    months = "|".join(fixed.MONTHS + fixed.MONTH_NAMES)
    p = rf"(?:posted|published|updated|date)\s*:\s*({months})\s+(\d{{1,2}})(?:,?\s*(\d{{4}}))?"
    month = f"list_position({sql_list(fixed.MONTHS)}, substr(regexp_extract({low}, '{p}', 1), 1, 3))"
    year = f"COALESCE(TRY_CAST(regexp_extract({low}, '{p}', 3) AS BIGINT), 2024)"
    day = f"TRY_CAST(regexp_extract({low}, '{p}', 2) AS BIGINT)"
    at = f"epoch(make_date({year}, {month}, 1)) + ({day} - 1) * 86400"
    parts.append(f"COALESCE(CASE WHEN regexp_matches({low}, '{p}') THEN ({AS_OF} - ({at})) / 86400.0 > {days} END, false)")
    return "(" + " OR ".join(parts) + ")"


@query(
    "hit_gates",
    with_(HITS, body=f"""SELECT page_id, {SQL_HOMEPAGE} AS homepage, {SQL_SEARCH_PAGE} AS search_page,
      {sql_any('title', fixed.NON_POSTING_TITLES)} AS other_title, {sql_any('href', fixed.NON_POSTING_URLS)} AS other_url,
      len(list_filter({sql_list(fixed.PORTAL_NON_POSTING_PATHS)}, lambda m: contains(href, m))) > 0 AS portal_listing,
      contains(href, '/job-listings-') AS portal_posting,
      {sql_relevant('title', ['devops', 'engineer', 'kubernetes', 'pune'])} AS relevant,
      {sql_snippet_old('body', 30)} AS too_old, {sql_junk('title')} AS junk_title FROM hits"""),
)
def hit_gates(spark, sf_dir):
    t, u, b = F.col("title"), F.col("href"), F.col("body")
    return hits(spark, sf_dir).select(
        "page_id", gates.is_homepage(u).alias("homepage"), gates.is_search_page(t, u).alias("search_page"),
        gates.is_non_posting_title(t).alias("other_title"), gates.is_non_posting_url(u).alias("other_url"),
        gates.is_portal_aggregate(u).alias("portal_listing"), urls.is_portal_posting(u).alias("portal_posting"),
        gates.is_relevant(t, F.lit("DevOps Engineer kubernetes"), F.lit("Pune")).alias("relevant"),
        times.snippet_older_than(b, 30, as_of()).alias("too_old"), gates.is_junk_title(t).alias("junk_title"),
    )


@query(
    "term_matches",
    r"""SELECT p_partkey,
      len(list_filter(['small', 'ring', 'blue'], lambda t: contains(lower(p_name || ' ' || p_type), t))) > 0 AS feed_match,
      list_has_any(['small', 'ring', 'blue'], regexp_extract_all(lower(p_name), '[a-z0-9+#.]+'))
        OR list_has_any(['small', 'ring', 'blue'], regexp_split_to_array(lower(p_type), ' ')) AS api_match FROM part""",
)
def term_matches(spark, sf_dir):
    terms = words.significant_terms(F.lit("the small ring of blue"))
    tags = F.split(F.lower("p_type"), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", gates.feed_term_match(F.col("p_name"), F.col("p_type"), terms).alias("feed_match"),
        (F.arrays_overlap(terms, words.tokenize(F.col("p_name"))) | F.arrays_overlap(terms, tags)).alias("api_match"),
    )


@query(
    "iso_recency",
    f"""SELECT event_id, COALESCE(({AS_OF} - epoch(TRY_CAST(replace(form, 'Z', '+00:00') AS TIMESTAMPTZ))) / 86400.0 > 14, false)
      AS too_old FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
        WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'n/a' ELSE '' END AS form FROM events)""",
)
def iso_recency(spark, sf_dir):
    k = F.col("event_id") % 4
    form = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd"))
        .when(k == 2, "n/a").otherwise("")
    )
    e = table(spark, sf_dir, "events").select("event_id", form.alias("form"))
    return e.select("event_id", times.iso_older_than(F.col("form"), 14, as_of()).alias("too_old"))


STATUSES = [200, 404, 410, 403, 500]
DEAD_TAILS = ["", " Sorry, this job has expired.", "", " Page Not Found", "", "", "We're sorry"]


def crawl(spark, sf_dir):
    k = F.col("page_id")
    site = F.regexp_extract("url", r"^https?://[^/]+", 0)
    final = (
        F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, site).when(k % 4 == 2, F.concat(site, F.lit("/en")))
        .otherwise(F.concat(site, F.lit("/Error")))
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (k % 5 + 1).cast("int")).alias("status"),
        final.alias("final_url"), F.concat(pick(DEAD_TAILS, k), F.col("html")).alias("body"),
    )


CRAWL = f"""
crawl AS (SELECT page_id, url, {STATUSES}[(page_id % 5 + 1)::INT] AS status,
  CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '^https?://[^/]+')
    WHEN 2 THEN regexp_extract(url, '^https?://[^/]+') || '/en' ELSE regexp_extract(url, '^https?://[^/]+') || '/Error' END AS final_url,
  {sql_pick(DEAD_TAILS, 'page_id')} || html AS body FROM pages)"""


def sql_path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def sql_dead_segment(u: str) -> str:
    return f"list_has_any(string_split(lower({sql_path(u)}), '/'), {sql_list(fixed.DEAD_PATH_SEGMENTS)})"


def sql_root(u: str) -> str:
    return f"regexp_full_match({sql_path(u)}, '/?|/([a-z]{{2}}|[a-z]{{2}}-[a-z]{{2}})/?')"


def sql_alive(body: str) -> str:
    return f"""NOT COALESCE(status IN (404, 410) OR ({sql_dead_segment('final_url')} AND NOT {sql_dead_segment('url')})
  OR (status < 400 AND {sql_root('final_url')} AND NOT {sql_root('url')})
  OR (status = 200 AND len(list_filter({sql_list(fixed.DEAD_BODY_MARKERS)}, lambda m: contains(lower({body}), m))) > 0), false)"""


# The code seeks markers in the whole body; the SQL of dead_posting_verdict and semantic_hits still reads its beginning.
SQL_ALIVE = sql_alive("substr(body, 1, 4096)")


@query("dead_posting_verdict", with_(CRAWL, body=f"SELECT page_id, {SQL_ALIVE} AS alive FROM crawl"))
def dead_posting_verdict(spark, sf_dir):
    alive = gates.is_alive(F.col("url"), F.col("status"), F.col("final_url"), F.col("body"))
    return crawl(spark, sf_dir).select("page_id", alive.alias("alive"))


@query(
    "scorer_eligibility",
    with_(shapes.POSTINGS, body="""SELECT posting_id, COALESCE(data_quality, '') IN ('full', 'partial')
      OR length(trim(description)) >= 60 AS eligible FROM postings"""),
)
def scorer_eligibility(spark, sf_dir):
    p = shapes.postings(spark, sf_dir)
    return p.select("posting_id", gates.scorer_eligible(F.col("data_quality"), F.col("description")).alias("eligible"))


@query(
    "window_stamps",
    f"""SELECT event_id, CASE WHEN width <= asked THEN {AS_OF} - width * 86400 + 120 END AS listed_epoch FROM (
      SELECT event_id, CASE label WHEN 'today' THEN 1 WHEN '3days' THEN 3 WHEN 'week' THEN 7 WHEN 'month' THEN 30 END AS width,
        CASE WHEN days = 0 THEN 7 ELSE days END AS asked
      FROM (SELECT event_id, (event_id % 40)::INT AS days, ['today', '3days', 'week', 'month', 'any'][(event_id % 5 + 1)::INT] AS label
        FROM events))""",
)
def window_stamps(spark, sf_dir):
    k = F.col("event_id")
    label = pick(["today", "3days", "week", "month", "any"], k)
    stamp = times.window_epoch(F.col("label"), F.col("days"), as_of())
    return table(spark, sf_dir, "events").select(
        "event_id", (k % 40).cast("int").alias("days"), label.alias("label")
    ).select("event_id", stamp.alias("listed_epoch"))
