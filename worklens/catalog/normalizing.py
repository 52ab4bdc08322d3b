"""Queries of the scalar normalizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, places, salary, times, words
from ..operators import normalize as norm
from . import shapes
from .registry import query
from .shapes import AS_OF, POSTINGS, as_of, pick, sql_list, sql_pick, table, with_


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- SQL of the check, written relationally ---------------------------------

CITY_KEYS = "city_keys(ord, key, city, generic) AS (VALUES " + ", ".join(
    f"({i}, {q(k)}, {q(c)}, {int(c in fixed.GENERIC_PLACES)})" for i, (k, c) in enumerate(fixed.CITY_SYNONYMS)
) + ")"
REGION_KEYS = "region_keys(ord, region, city) AS (VALUES " + ", ".join(
    f"({i}, {q(r)}, {q(c)})" for i, (r, cs) in enumerate(fixed.REGION_CITIES) for c in cs
) + ")"


def sql_city_map(name: str, source: str, column: str, exclude: tuple[str, ...] = (), fallback: bool = True) -> str:
    """CTEs ``name(raw, city)`` over the distinct values of ``column``."""
    skip = f"AND key NOT IN ({', '.join(q(x) for x in exclude)})" if exclude else ""
    word = (
        r"regexp_extract(trim(raw), '\b([A-Z][a-zA-Z]{2,}(?: [A-Z][a-zA-Z]+)?)\b', 1)" if fallback else "''"
    )
    return rf"""
{name}_raw AS (SELECT DISTINCT {column} AS raw FROM {source}),
{name}_hit AS (
  SELECT raw, city, generic, ord,
    strpos(' ' || regexp_replace(lower(raw), '[^a-z0-9]', ' ', 'g') || ' ',
           ' ' || replace(key, '-', ' ') || ' ') AS pos
  FROM {name}_raw, city_keys WHERE pos > 0 {skip}),
{name}_first AS (SELECT raw, city, generic, arg_min(pos, ord) AS pos FROM {name}_hit GROUP BY ALL),
{name}_best AS (SELECT raw, first(city ORDER BY generic, pos, city) AS city FROM {name}_first GROUP BY raw),
{name}_word AS (SELECT raw, {word} AS word FROM {name}_raw),
{name} AS (
  SELECT w.raw, COALESCE(b.city,
    CASE WHEN lower(word) IN ('india', 'remote') OR length(word) > 25 THEN '' ELSE word END) AS city
  FROM {name}_word w LEFT JOIN {name}_best b ON w.raw = b.raw)"""


REGION_MAP = "region_map AS (SELECT city, first(region ORDER BY ord) AS region FROM region_keys GROUP BY city)"


def sql_listed(raw: str) -> str:
    ago = r"(\d+)\s*(second|minute|hour|day|week|month|year)s?\s+ago"
    formats = [
        "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d", "%d %b %Y", "%b %d, %Y", "%B %d, %Y",
        "%d %B %Y", "%d-%m-%Y", "%d/%m/%Y",
    ]
    cleaned = rf"replace(regexp_replace(trim({raw}), '^(posted|published|updated|date)\s*:?\s*', '', 'i'), 'Z', '+00:00')"
    absolute = ", ".join(f"epoch(try_strptime({cleaned}, '{f}'))::BIGINT" for f in formats)
    return rf"""CASE
    WHEN regexp_matches({raw}, '{ago}', 'i') THEN {AS_OF} - 86400
      * TRY_CAST(regexp_extract({raw}, '{ago}', 1, 'i') AS BIGINT)
      * CASE lower(regexp_extract({raw}, '{ago}', 2, 'i')) WHEN 'day' THEN 1 WHEN 'week' THEN 7
          WHEN 'month' THEN 30 WHEN 'year' THEN 365 ELSE 0 END
    WHEN regexp_matches({raw}, '\bjust now\b', 'i') THEN {AS_OF}
    WHEN regexp_matches({raw}, '\btoday\b', 'i') THEN {AS_OF} - 3600
    WHEN regexp_matches({raw}, '\byesterday\b', 'i') THEN {AS_OF} - 86400
    ELSE COALESCE({absolute}) END"""


def sql_salary(column: str) -> str:
    t = f"replace({column}, ',', '')"
    unit, one, crore = fixed.SALARY_UNIT_RANGE, fixed.SALARY_UNIT_SINGLE, fixed.SALARY_CRORE
    amount, thousand, month = fixed.SALARY_AMOUNT_RANGE, fixed.SALARY_THOUSANDS, fixed.SALARY_MONTHLY

    def has(p: str) -> str:
        return f"regexp_matches({t}, '{p}', 'i')"

    def grab(p: str, *groups: int) -> str:
        parts = ", ".join(f"nullif(regexp_extract({t}, '{p}', {g}, 'i'), '')" for g in groups)
        return f"TRY_CAST(COALESCE({parts}) AS DOUBLE)"

    def whole(x: str) -> str:
        return f"GREATEST(1, round_even({x}, 0)::INT)"

    monthly = f"CASE WHEN {has(month)} THEN 12 ELSE 1 END"
    return f"""CASE
    WHEN {has(fixed.SALARY_UNDISCLOSED)} THEN NULL
    WHEN {has(unit)} THEN {whole(grab(unit, 2))}
    WHEN {has(one)} THEN {whole(grab(one, 1))}
    WHEN {has(crore)} THEN {whole(grab(crore, 2, 1) + ' * 100')}
    WHEN {has(thousand)} AND {has(month)} THEN {whole(grab(thousand, 2, 1) + ' * 12 / 100')}
    WHEN {has(amount)} THEN {whole(grab(amount, 2) + f' * {monthly} / 100000')} END"""


REMOTE = (
    r"(^|[^a-z0-9_])(remote|work from home|work-from-home|wfh|telecommute|anywhere|virtual|hybrid|home based)"
    r"([^a-z0-9_]|$)"
)


def sql_remote(location: str, workplace: str, description: str) -> str:
    return (
        f"(regexp_matches(lower({location} || ' ' || {workplace}), '{REMOTE}')"
        f" OR contains(lower(substr({description}, 1, 400)), 'remote'))"
    )


#: CTE chain ending in ``normalized``: every posting with its typed columns.
NORMALIZED = ",\n".join(
    [
        POSTINGS.strip(), CITY_KEYS, REGION_KEYS, REGION_MAP,
        sql_city_map("place_city", "postings", "location").strip(),
        f"""normalized AS (
  SELECT p.*, {sql_listed('p.listed')} AS listed_epoch, {sql_salary('p.salary')} AS salary_int,
    c.city, COALESCE(r.region, '') AS region,
    {sql_remote('p.location', 'p.workplace_type', 'p.description')} AS remote_ok
  FROM postings p JOIN place_city c ON p.location = c.raw
  LEFT JOIN region_map r ON lower(c.city) = r.city)""",
    ]
)


def normalized(spark, sf_dir):
    return norm.normalize(norm.conform(shapes.postings(spark, sf_dir)), as_of())


# --- queries ------------------------------------------------------------------


@query(
    "posting_epoch",
    with_(POSTINGS, body=f"""SELECT posting_id, {sql_listed('listed')} AS listed_epoch,
      CASE WHEN regexp_matches(listed, '\\d+\\s*(hour|day|week)s?\\s+ago', 'i') THEN true ELSE false END AS is_relative
      FROM postings"""),
)
def posting_epoch(spark, sf_dir):
    p = norm.conform(shapes.postings(spark, sf_dir))
    epoch = times.listed_epoch(F.col("listed_epoch"), F.col("listed"), F.col("epoch"), F.col("listed_date"), as_of())
    return p.select("posting_id", epoch.alias("listed_epoch"), times.is_relative(F.col("listed")).alias("is_relative"))


AGE_FORMS = [
    "3 seconds ago", "10 minutes ago", "5 hours ago", "1 day ago", "Posted 9 days ago", "2 weeks ago",
    "4 Months ago", "1 year ago", "Just now", "posted today", "Yesterday", "soon", "",
]


@query(
    "relative_time",
    f"""SELECT event_id, form, {sql_listed('form')} AS at FROM (
      SELECT event_id, {sql_pick(AGE_FORMS, 'event_id')} AS form FROM events)""",
)
def relative_time(spark, sf_dir):
    form = pick(AGE_FORMS, F.col("event_id"))
    e = table(spark, sf_dir, "events").select("event_id", form.alias("form"))
    return e.select("event_id", "form", times.relative_epoch(F.col("form"), as_of()).alias("at"))


@query(
    "absolute_time",
    f"""SELECT o_orderkey, form, {sql_listed('form')} AS at FROM (
      SELECT o_orderkey, CASE o_orderkey % 7
        WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d %b %Y')
        WHEN 2 THEN strftime(o_orderdate, '%b %d, %Y') WHEN 3 THEN 'Posted: ' || strftime(o_orderdate, '%B %d, %Y')
        WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30Z')
        ELSE 'on ' || strftime(o_orderdate, '%Y-%m-%d') END AS form FROM orders)""",
)
def absolute_time(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    form = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd MMM yyyy"))
        .when(k == 2, F.date_format(d, "MMM dd, yyyy"))
        .when(k == 3, F.concat(F.lit("Posted: "), F.date_format(d, "MMMM dd, yyyy")))
        .when(k == 4, F.date_format(d, "dd/MM/yyyy"))
        .when(k == 5, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:20:30Z")))
        .otherwise(F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd")))
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", form.alias("form"))
    return o.select("o_orderkey", "form", times.absolute_epoch(F.col("form")).alias("at"))


@query(
    "salary_upper_bound",
    with_(POSTINGS, body=f"SELECT posting_id, salary, {sql_salary('salary')} AS salary_int FROM postings"),
)
def salary_upper_bound(spark, sf_dir):
    p = shapes.postings(spark, sf_dir)
    return p.select("posting_id", "salary", salary.salary_int(F.col("salary")).alias("salary_int"))


@query(
    "city_and_region",
    with_(
        POSTINGS, CITY_KEYS, REGION_KEYS, REGION_MAP, sql_city_map("m", "postings", "location"),
        body="""SELECT posting_id, m.city, COALESCE(r.region, '') AS region FROM postings p
          JOIN m ON p.location = m.raw LEFT JOIN region_map r ON lower(m.city) = r.city""",
    ),
)
def city_and_region(spark, sf_dir):
    p = shapes.postings(spark, sf_dir).select("posting_id", places.city(F.col("location")).alias("city"))
    return p.select("posting_id", "city", places.region_of(F.col("city")).alias("region"))


TEXT_PLACES = [" in Managing NCR systems", " office in Pune", " bangalore or Hyderabad", " work from home", " pan india", ""]


@query(
    "city_in_free_text",
    with_(
        f"texts AS (SELECT doc_id, text || {sql_pick(TEXT_PLACES, 'doc_id')} AS body FROM documents)",
        CITY_KEYS, sql_city_map("m", "texts", "body", tuple(fixed.FREE_TEXT_EXCLUDED), False),
        body="SELECT doc_id, m.city FROM texts JOIN m ON texts.body = m.raw",
    ),
)
def city_in_free_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.col("text"), pick(TEXT_PLACES, F.col("doc_id")))
    return d.select("doc_id", places.city_in_text(body).alias("city"))


@query(
    "remote_flag",
    with_(POSTINGS, body=f"""SELECT posting_id,
      {sql_remote('location', 'workplace_type', 'description')} AS remote_ok FROM postings"""),
)
def remote_flag(spark, sf_dir):
    p = shapes.postings(spark, sf_dir)
    flag = places.is_remote(F.col("location"), F.col("workplace_type"), F.col("description"))
    return p.select("posting_id", flag.alias("remote_ok"))


@query(
    "normalized_postings",
    with_(NORMALIZED, body="""SELECT posting_id, title, url, listed_epoch, salary_int, city, region, remote_ok,
      workplace_type AS workplace FROM normalized"""),
)
def normalized_postings(spark, sf_dir):
    return normalized(spark, sf_dir).select(
        "posting_id", "title", "url", "listed_epoch", "salary_int", "city", "region", "remote_ok", "workplace"
    )


_PARTS = r"regexp_split_to_array(p_location, '(?i)[,;/&|]|\b(?:and|or)\b')"


@query(
    "preference_places",
    with_(
        shapes.PROFILES, CITY_KEYS, REGION_KEYS, REGION_MAP,
        f"parts AS (SELECT profile_id, p_location, i, {_PARTS}[i] AS part FROM profiles, "
        f"LATERAL (SELECT unnest(range(1, len({_PARTS}) + 1)) AS i))",
        sql_city_map("m", "parts", "part"),
        """placed AS (SELECT profile_id, p_location, i, trim(part) AS part, m.city, COALESCE(r.region, '') AS region
          FROM parts JOIN m ON parts.part = m.raw LEFT JOIN region_map r ON lower(m.city) = r.city)""",
        body="""SELECT profile_id,
          COALESCE(array_to_string(list_sort(list_distinct(list(city) FILTER (city <> ''))), ','), '') AS cities,
          COALESCE(array_to_string(list_sort(list_distinct(list(region) FILTER (region <> ''))), ','), '') AS regions,
          CASE WHEN count(*) FILTER (part <> '') <= 1 THEN trim(any_value(p_location))
            WHEN bool_and(city <> '' AND region <> '') FILTER (part <> '') THEN 'India'
            ELSE first(part ORDER BY i) FILTER (part <> '') END AS source_location
          FROM placed GROUP BY profile_id""",
    ),
)
def preference_places(spark, sf_dir):
    loc = F.col("p_location")
    return shapes.profiles(spark, sf_dir).select(
        "profile_id",
        F.array_join(F.array_sort(places.preference_cities(loc)), ",").alias("cities"),
        F.array_join(F.array_sort(places.preference_regions(loc)), ",").alias("regions"),
        places.source_location(loc).alias("source_location"),
    )


@query(
    "match_keys",
    with_(POSTINGS, r"""keyed AS (SELECT posting_id, list_transform([title, company], lambda x:
        trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '\b(ii|iii|iv|sr?|jr)\b', '', 'g'),
          '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS k FROM postings)""",
        body="SELECT posting_id, k[1] AS title_key, k[2] AS company_key FROM keyed"),
)
def match_keys(spark, sf_dir):
    p = shapes.postings(spark, sf_dir)
    return p.select(
        "posting_id", words.match_key(F.col("title")).alias("title_key"),
        words.match_key(F.col("company")).alias("company_key"),
    )


@query(
    "token_sets",
    r"""SELECT doc_id,
      len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#.]+'))) AS n_tokens,
      len(list_distinct(list_filter(regexp_extract_all(text_low, '[a-z0-9+#.]+\b'), lambda t: length(t) >= 3))) AS n_long
      FROM (SELECT doc_id, text, regexp_replace(lower(text), '[^\x00-\x7f]', '_', 'g') AS text_low FROM documents)""",
)
def token_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # The boundary of the long form is tested on text whose non-ASCII letters
    # are one word character, so that both engines agree on it.
    ascii_text = F.regexp_replace(F.lower(F.col("text")), r"[^\x00-\x7f]", "_")
    return d.select(
        "doc_id",
        F.size(words.tokenize(F.col("text"))).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(words.long_tokens(ascii_text))).cast("bigint").alias("n_long"),
    )


_STOP = sql_list(fixed.STOP_WORDS)


@query(
    "significant_terms",
    rf"""SELECT id, array_to_string(list_sort(CASE WHEN len(kept) > 0 THEN kept ELSE terms END), ' ') AS terms,
      len(list_filter(blanks, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))) >= 2 AS is_valid_query
      FROM (SELECT id, terms, blanks,
          list_filter(terms, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)) AS kept
        FROM (SELECT item_id AS id, blanks, list_distinct(list_filter(blanks, lambda t: t <> '')) AS terms
          FROM (SELECT item_id, regexp_split_to_array(lower(text), '\s+') AS blanks FROM benchmark)))""",
)
def significant_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("id"),
        F.array_join(F.array_sort(words.significant_terms(F.col("text"))), " ").alias("terms"),
        words.valid_query(F.col("text")).alias("is_valid_query"),
    )


@query(
    "skill_variants",
    with_(
        shapes.PROFILES,
        "variant_map(skill, variants) AS (VALUES "
        + ", ".join(f"({q(k)}, {sql_list(v)})" for k, v in fixed.SKILL_VARIANTS.items()) + ")",
        "mine AS (SELECT profile_id, unnest(p_skills) AS skill FROM profiles)",
        body="""SELECT profile_id, m.skill, array_to_string(COALESCE(v.variants, [lower(trim(m.skill))]), '|') AS variants
          FROM mine m LEFT JOIN variant_map v ON lower(trim(m.skill)) = v.skill""",
    ),
)
def skill_variants(spark, sf_dir):
    p = shapes.profiles(spark, sf_dir).select("profile_id", F.explode("p_skills").alias("skill"))
    return p.select("profile_id", "skill", F.array_join(words.skill_variants(F.col("skill")), "|").alias("variants"))


def sql_title_level(title: str) -> str:
    tokens = f"regexp_extract_all(lower({title}), '[a-z0-9+#.]+')"
    return "CASE " + " ".join(
        f"WHEN list_has_any({tokens}, {sql_list(names)}) THEN '{level}'" for level, names in fixed.SENIORITY_WORDS
    ) + " END"


def sql_years_level(years: str) -> str:
    return (
        f"CASE WHEN {years} <= 1 THEN 'entry' WHEN {years} <= 4 THEN 'mid' WHEN {years} <= 8 THEN 'senior' "
        f"WHEN {years} IS NOT NULL THEN 'staff' END"
    )


@query(
    "seniority_levels",
    with_(POSTINGS, body=f"""SELECT posting_id, {sql_title_level('title')} AS title_level,
      {sql_years_level('(posting_id % 13)')} AS years_level FROM postings"""),
)
def seniority_levels(spark, sf_dir):
    p = shapes.postings(spark, sf_dir)
    return p.select(
        "posting_id", words.level_from_title(F.col("title")).alias("title_level"),
        words.level_from_years(F.col("posting_id") % 13).alias("years_level"),
    )


@query(
    "window_labels",
    """SELECT event_id, days,
      CASE WHEN days = 0 THEN '' WHEN days <= 1 THEN 'd' WHEN days <= 7 THEN 'w' ELSE 'm' END AS time_limit,
      CASE WHEN days <= 7 THEN 'week' WHEN days <= 30 THEN 'month' ELSE 'any' END AS date_posted,
      CASE WHEN days >= 14 THEN 14 WHEN days >= 7 THEN 7 WHEN days >= 3 THEN 3 ELSE 1 END AS age_flag,
      CASE WHEN days = 0 THEN 'week' WHEN days <= 1 THEN 'today' WHEN days <= 3 THEN '3days' WHEN days <= 7
        THEN 'week' ELSE 'month' END AS window_label
      FROM (SELECT event_id, (event_id % 40)::INT AS days FROM events)""",
)
def window_labels(spark, sf_dir):
    d = F.col("days")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 40).cast("int").alias("days"))
    return e.select(
        "event_id", "days", times.time_limit(d).alias("time_limit"), times.date_posted_flag(d).alias("date_posted"),
        times.age_flag(d).alias("age_flag"), times.window_label(d).alias("window_label"),
    )


