"""Queries of the text, URL and JSON extractors, the scorer answers and the profile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, fixed, pages, urls, words
from ..operators import profiles, scorer
from . import shapes
from .normalizing import q
from .registry import query
from .shapes import PAIRS, POSTINGS, PROFILES, pick, sql_list, sql_pick, table, with_

RAW_TITLES = [
    "DevOps Engineer - LinkedIn", "Acme is hiring Data Engineer in Pune", "Platform Engineer | Acme - Indeed.com",
    "Python Developer - Naukri.com", "Python Developer Jobs In Pune - 561", "SRE – Hiring now", "  Backend Developer  ",
    "Apply To 12 Java Developer", "12 Data Analyst", "How to become rich", "- - ", "Cloud Engineer - 3 Vacancies",
    "Staff Engineer - Job Opening", "Globex hiring Analyst",
]


def sql_replace(x: str, pattern: str, by: str = "", flags: str = "gi") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, '{flags}')"


_BOARD = sql_replace(sql_replace("title", fixed.BOARD_SUFFIX), fixed.NOISE_SUFFIX)
_LEAD = fixed.HIRING_LEAD


def sql_first(x: str) -> str:
    seg = rf"trim(regexp_split_to_array({x}, '\s*[-–|]\s*')[1])"
    return f"CASE WHEN {seg} <> '' THEN {seg} ELSE trim({x}) END"


_WEB = (
    f"CASE WHEN regexp_matches({_BOARD}, '{_LEAD}', 'i') THEN trim(regexp_replace(trim({sql_replace(_BOARD, _LEAD, '', 'i')}), "
    rf"'\s+in\s+[A-Z][a-zA-Z\s,]*$', '')) ELSE {_BOARD} END"
)


def _portal() -> str:
    out = "title"
    for pattern, ignore, trim in fixed.PORTAL_TITLE_REWRITES:
        out = sql_replace(out, pattern, "", "gi" if ignore else "g")
        out = f"trim({out})" if trim else out
    return f"trim({out}, ' ,-–')"


@query(
    "clean_titles",
    f"""WITH t AS (SELECT doc_id, {sql_pick(RAW_TITLES, 'doc_id')} AS title FROM documents),
      b AS (SELECT doc_id, title, {_BOARD} AS board, {_WEB} AS web FROM t)
      SELECT doc_id, {sql_first('board')} AS board_title, {sql_first('web')} AS web_title, {_portal()} AS portal_title FROM b""",
)
def clean_titles(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", pick(RAW_TITLES, F.col("doc_id")).alias("title"))
    c = F.col("title")
    return t.select(
        "doc_id", extract.clean_board_title(c).alias("board_title"), extract.clean_web_title(c).alias("web_title"),
        extract.clean_portal_title(c).alias("portal_title"),
    )


HOSTS = [
    "jobs.sanofi.com", "koch.avature.net", "acme.wd5.myworkdayjobs.com", "boards.greenhouse.io", "opportunities.vodafone.com",
    "www.example.in", "wd5.myworkdayjobs.com", "careers.google.com", "lever.co", "example",
]


def sql_title_case(x: str) -> str:
    """Title case for words of letters and digits between blanks or other signs."""
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    )


def _labels(host: str) -> str:
    return f"string_split(regexp_replace({host}, '^www[0-9]*\\.', ''), '.')"


_NOT_NAME = sql_list(fixed.TLD_LABELS + fixed.GENERIC_HOST_LABELS)
_PLATFORM = sql_list(fixed.PLATFORM_LABELS)


#: From the labels ``l`` of a host: those that may name its company, and the name.
_HOST_PARTS = f"""list_filter(l, lambda x: NOT list_contains({_NOT_NAME}, x) AND NOT regexp_full_match(x, 'wd[0-9]+')) AS rest,
        list_filter(l[1:len(l) - 1], lambda x: NOT list_contains({_NOT_NAME}, x) AND NOT regexp_full_match(x, 'wd[0-9]+')
          AND NOT list_contains({_PLATFORM}, x)) AS named"""
_HOST_COMPANY = f"""CASE WHEN len(named) > 0 THEN {sql_title_case('named[1]')}
        WHEN len(list_filter(rest, lambda x: NOT list_contains({_PLATFORM}, x))) = 0 THEN ''
        ELSE {sql_title_case('rest[-1]')} END"""


@query(
    "company_from_host",
    f"""WITH h AS (SELECT c_custkey, {_labels(sql_pick(HOSTS, 'c_custkey'))} AS l FROM customer),
      n AS (SELECT c_custkey, l, {_HOST_PARTS} FROM h) SELECT c_custkey, {_HOST_COMPANY} AS company FROM n""",
)
def company_from_host(spark, sf_dir):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://"), pick(HOSTS, k), F.lit("/job/"), k.cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", urls.company_from_host(url).alias("company"))


SNIPPETS = [
    "We work at Globex Corp - apply", "Initech is hiring engineers in Pune", "posted by The Team in India", "hosted via Acme. Now",
    "a role in Managing cloud", "based in Noida, UP today", "", "Remote work",
]
_COMPANY1 = r"(?:at|by|via)\s+([A-Z][A-Za-z0-9&. ]+?)(?:\s+[-–]|\s+(?:is|has|in)\s+|$|\.)"
_COMPANY2 = r"([A-Z][A-Za-z0-9&. ]+?)\s+(?:is\s+)?(?:hiring|seeking|looking)"
_STOP = sql_list(fixed.STOP_WORDS)


def sql_company(pattern: str) -> str:
    name = f"trim(regexp_extract(snippet, '{pattern}', 1, 'i'))"
    return (
        rf"CASE WHEN length({name}) >= 3 AND NOT list_contains({_STOP}, lower(regexp_split_to_array({name}, '\s+')[1])) THEN {name} END"
    )


_SKIP = sql_list(fixed.SKIP_DOMAIN_LABELS)


@query(
    "company_from_text",
    f"""WITH t AS (SELECT c_custkey, {sql_pick(SNIPPETS, 'c_custkey')} AS snippet, {sql_pick(RAW_TITLES, 'c_custkey')} AS title,
        {_labels(sql_pick(HOSTS, 'c_custkey'))} AS l FROM customer),
      n AS (SELECT *, list_filter(l, lambda x: NOT list_contains({_SKIP}, x))[1] AS label FROM t)
      SELECT c_custkey, COALESCE({sql_company(_COMPANY1)}, {sql_company(_COMPANY2)},
        nullif(trim(regexp_extract(title, '^([A-Z][A-Za-z0-9\\s&.]+?)\\s+(?:is\\s+)?hiring\\s+', 1, 'i')), ''),
        {sql_title_case('COALESCE(label, l[1])')}) AS company FROM n""",
)
def company_from_text(spark, sf_dir):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://"), pick(HOSTS, k), F.lit("/x"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", extract.company_from_text(url, pick(SNIPPETS, k), pick(RAW_TITLES, k)).alias("company")
    )


SLUGS = [
    "python-developer-varite-kolkata-hyderabad-bengaluru-8-to-13-years", "devops-engineer-tata-consultancy-services-pune-2-to-5-years",
    "data-analyst-acme-solutions-remote-fresher", "sre-globex-labs", "cloud-lead-wipro-digital-technologies-noida-3-to-6-years",
    "pune-mumbai-2-to-4-years", "java-developer-infosys-chennai-0-to-1-yrs",
]


def _sql_slug() -> str:
    city, generic = sql_list(fixed.CITY_SLUGS), sql_list(fixed.GENERIC_COMPANY_WORDS)
    return f"""WITH s AS (SELECT p_partkey, list_filter(string_split({sql_pick(SLUGS, 'p_partkey')}, '-'), lambda x:
        NOT regexp_full_match(x, '[0-9]+(\\.[0-9]+)?') AND NOT list_contains(['to', 'years', 'year', 'yrs', 'yr', 'fresher', 'exp'], x)) AS p,
        {sql_pick(SLUGS, 'p_partkey')} AS slug FROM part),
      m AS (SELECT *, COALESCE(list_max(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN list_contains({city}, p[i]) THEN 0 ELSE i END)), 0) AS last FROM s),
      g AS (SELECT *, CASE WHEN last >= 3 AND list_contains({generic}, p[last]) AND list_contains({generic}, p[last - 1]) THEN 3
        WHEN last >= 2 AND list_contains({generic}, p[last]) THEN 2 ELSE 1 END AS take FROM m)
      SELECT p_partkey, CASE WHEN last = 0 THEN '' ELSE {sql_title_case("array_to_string(p[GREATEST(last - take + 1, 1):last], ' ')")} END AS company,
        array_to_string(list_transform(list_filter(p, lambda x: list_contains({city}, x)), lambda c: upper(substr(c, 1, 1)) || substr(c, 2)), ', ') AS locations,
        {sql_title_case("replace(regexp_extract('/job-listings-' || slug || '-123456', '/job-listings-([^/]+?)-([0-9])', 1), '-', ' ')")} AS slug_title FROM g"""


@query("slug_fields", _sql_slug())
def slug_fields(spark, sf_dir):
    url = F.concat(F.lit("https://www.naukri.com/job-listings-"), pick(SLUGS, F.col("p_partkey")), F.lit("-123456"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", urls.company_from_slug(url).alias("company"), urls.locations_from_slug(url).alias("locations"),
        extract.title_from_slug(url).alias("slug_title"),
    )


@query(
    "portal_locations",
    rf"""WITH t AS (SELECT c_custkey, {sql_pick(SNIPPETS, 'c_custkey')} AS s, {sql_pick(['Pune', ''], 'c_custkey')} AS asked FROM customer),
      m AS (SELECT *, trim(regexp_extract(s, 'in\s+([A-Z][a-zA-Z\s]+(?:,\s*[A-Z]{{2}})?)', 1, 'i')) AS a,
        trim(regexp_extract(s, '([A-Z][a-zA-Z\s]+(?:,\s*[A-Z]{{2}}))(?:\s+[.…]|\s*$)', 1, 'i')) AS b FROM t)
      SELECT c_custkey, CASE WHEN a <> '' AND length(a) < 30 THEN a WHEN b <> '' AND length(b) < 30 THEN b
        WHEN asked <> '' THEN asked ELSE 'India' END AS location FROM m""",
)
def portal_locations(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", extract.portal_location(pick(SNIPPETS, k), pick(["Pune", ""], k)).alias("location")
    )


@query(
    "url_forms",
    r"""WITH u AS (SELECT o_orderkey AS k, 1000000 + o_orderkey AS n FROM orders)
      SELECT k, 'https://www.linkedin.com/jobs/view/' || n AS canonical, 'https://www.linkedin.com/jobs/view/' || n AS kept,
        CASE k % 3 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/9' || n WHEN 1 THEN 'https://apply.acme.com/' || k ELSE 'https://base/' || k END AS apply_url,
        CASE k % 2 WHEN 0 THEN 'https://in.indeed.com/viewjob?jk=a' || k ELSE 'https://in.indeed.com/cmp/x?jk=a' || k END AS resolved,
        CASE k % 2 WHEN 0 THEN 'https://acme.com/a b/' || k ELSE 'https://other.com/?uddg=x' END AS unwrapped,
        'user-' || k AS handle FROM u""",
)
def url_forms(spark, sf_dir):
    k = F.col("o_orderkey")
    s, n = k.cast("string"), (F.lit(1000000) + k).cast("string")
    view = F.concat(F.lit("https://in.linkedin.com/jobs/view/devops-engineer-"), n, F.lit("?position=1"))
    stable = F.when(
        k % 3 == 0, urls.stable_apply_url(F.lit(""), F.concat(F.lit("https://www.linkedin.com/job-apply/9"), n))
    ).when(k % 3 == 1, urls.stable_apply_url(F.lit("https://b"), F.concat(F.lit("https://apply.acme.com/"), s))).otherwise(
        urls.stable_apply_url(F.concat(F.lit("https://base/"), s), F.lit("https://www.linkedin.com/job-apply/1"))
    )
    tracked = F.when(k % 2 == 0, F.concat(F.lit("https://in.indeed.com/rc/clk?from=x&jk=a"), s)).otherwise(
        F.concat(F.lit("https://in.indeed.com/cmp/x?jk=a"), s)
    )
    wrapped = F.when(
        k % 2 == 0, F.concat(F.lit("//duckduckgo.com/l/?uddg=https%3A%2F%2Facme.com%2Fa%20b%2F"), s, F.lit("&rut=1"))
    ).otherwise("https://other.com/?uddg=x")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), urls.canonical_job_url(view).alias("canonical"),
        urls.canonical_job_url(F.concat(F.lit(" https://www.linkedin.com/jobs/view/"), n, F.lit(" "))).alias("kept"),
        stable.alias("apply_url"), urls.resolve_tracking_url(tracked).alias("resolved"),
        urls.unwrap_redirect(wrapped).alias("unwrapped"),
        urls.profile_handle(F.concat(F.lit("https://www.linkedin.com/in/user-"), s, F.lit("/detail"))).alias("handle"),
    )


SECRETS = [
    " see https://bob:pw@host.example/x?token=abc&u=1", " GET https://a.example/?q=1&api_key=zzz#sig=1", " proxy bob:pw@host.example",
    " nothing here",
]


@query(
    "redacted_text",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z][A-Za-z0-9+.\-]{{0,19}}://)[^/\s@]+@', '\1***@', 'g'),
        '(^|[^A-Za-z0-9._%+\-:/@])([^:/\s@]+:[^/\s@]+@)([A-Za-z0-9.\-\[])', '\1***@\3', 'g'),
        '([?&#](?:access[_-]?token|auth[_-]?token|token|bearer|api[_-]?key|key|password|passwd|secret|signature|sig|session(?:id)?|cookie|credential)=)[^&#\s]*', '\1***', 'gi') AS redacted
      FROM (SELECT doc_id, text || {sql_pick(SECRETS, 'doc_id')} AS t FROM documents)""",
)
def redacted_text(spark, sf_dir):
    t = F.concat(F.col("text"), pick(SECRETS, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", urls.redact(t).alias("redacted"))


RESUME_TAILS = [" 5+ years of experience and 12 yrs work", " experience: 7 in data", " no numbers", " exp of 3", " 10 years exp"]


@query(
    "resume_years",
    rf"""WITH t AS (SELECT doc_id, lower(text || {sql_pick(RESUME_TAILS, 'doc_id')}) AS s FROM documents)
      SELECT doc_id, COALESCE(
        list_max(list_transform(regexp_extract_all(s, '(\d+)\+?\s*(?:years?|yrs?|yr)\s*(?:of)?\s*(?:experience|exp|work)?', 1), lambda x: TRY_CAST(x AS BIGINT))),
        list_max(list_transform(regexp_extract_all(s, '(?:experience|exp)\s*(?:of|:)?\s*(\d+)', 1), lambda x: TRY_CAST(x AS BIGINT)))) AS years FROM t""",
)
def resume_years(spark, sf_dir):
    t = F.concat(F.col("text"), pick(RESUME_TAILS, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", words.years_of_experience(t).alias("years"))


# --- rendered pages -----------------------------------------------------------------

PAGE_COMPANIES = ["Varite", "Globex", "Acme Labs"]
PAGE_SALARIES = ["₹ 8-13 LPA", "Not disclosed", "₹ 1,20,000 lakhs", "no pay line"]
PAGE_EXPERIENCE = ["8 to 13 Years", "Fresher", "4 years", "-"]
PAGE_PLACES = ["Kolkata, Hyderabad, Bengaluru", "Pune", "Remote", "Gotham City Center Place"]
PAGE_LISTED = ["Posted: 2 days ago", "Updated Jan 5, 2024", "Posted today", "."]


def rendered_pages(spark, sf_dir):
    """Portal pages in their rendered form around the body text of each page."""
    k = F.col("page_id")
    url = F.concat(
        F.lit("https://www.naukri.com/job-listings-"), pick(SLUGS, k), F.lit("-"), (k + 100000).cast("string")
    )
    body = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")
    page = F.concat(
        F.lit("Title: Python Developer - Naukri.com\n\nURL Source: "), url, F.lit("\n\nMarkdown Content:\n[**"),
        pick(["Python Developer", "Senior SRE", "Data Analyst"], k), F.lit("**]("), url, F.lit(")\n["), pick(PAGE_COMPANIES, k),
        F.lit("](https://www.naukri.com/company/x)\n\n"), pick(PAGE_PLACES, k), F.lit("\n\n"), pick(PAGE_SALARIES, k), F.lit("\n\n"),
        pick(PAGE_EXPERIENCE, k), F.lit("\n\nFull-Time\n\n"), pick(PAGE_LISTED, k), F.lit("\n\n**About the job**\n"), body,
        F.lit("\n\n**Key Skills**\nPython, Django\nAWS\n- skip\n\n**About Company**\nA company.\n\n[Apply Now]("), url, F.lit("?src=apply)\n"),
    )
    expired = F.concat(F.lit("Title: Python Developer Jobs In Pune - 561 Job Vacancies In Pune\n\n"), body)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.when(k % 9 == 8, expired).otherwise(page).alias("page"))


def sql_page() -> str:
    return rf"""WITH p AS (SELECT page_id AS k, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body,
        {sql_pick(SLUGS, 'page_id')} AS slug FROM pages)
      SELECT k AS page_id, k % 9 = 8 AS expired,
        CASE WHEN k % 9 <> 8 THEN {sql_pick(["Python Developer", "Senior SRE", "Data Analyst"], 'k')} END AS title,
        CASE WHEN k % 9 <> 8 THEN {sql_pick(PAGE_COMPANIES, 'k')} END AS company,
        CASE WHEN k % 9 <> 8 THEN {sql_list(["₹8-13 LPA", "Not Disclosed", "₹120000 lakhs", ""])}[(k % 4 + 1)::INT] END AS salary,
        CASE WHEN k % 9 <> 8 THEN CASE WHEN contains(slug, 'fresher') THEN 'Fresher' ELSE {sql_list(["8-13 Years", "Fresher", "4 Years", ""])}[(k % 4 + 1)::INT] END END AS experience,
        CASE WHEN k % 9 <> 8 THEN 'Python, Django, AWS' END AS keyskills,
        CASE WHEN k % 9 <> 8 THEN {sql_list(["2 days ago", "Jan 5, 2024", "today", ""])}[(k % 4 + 1)::INT] END AS listed,
        CASE WHEN k % 9 <> 8 THEN body END AS description,
        CASE WHEN k % 9 <> 8 THEN 'https://www.naukri.com/job-listings-' || slug || '-' || (k + 100000) || '?src=apply' END AS apply_url FROM p"""


@query("rendered_page_fields", sql_page())
def rendered_page_fields(spark, sf_dir):
    p = rendered_pages(spark, sf_dir).select(
        "page_id", pages.is_expired(F.col("page")).alias("expired"),
        pages.rendered_fields(F.col("page"), F.col("url")).alias("f"),
    )
    return p.select(
        "page_id", "expired",
        *[f"f.{n}" for n in ("title", "company", "salary", "experience", "keyskills", "listed", "description", "apply_url")],
    )




SQL_PAGE_PLACE = f"""CASE page_id % 4 WHEN 0 THEN 'Kolkata, Hyderabad, Bengaluru' WHEN 1 THEN 'Pune' WHEN 2 THEN 'Remote'
        ELSE {sql_list(["Kolkata, Hyderabad, Bengaluru", "Pune", "Remote", "", "Noida", "Pune, Mumbai", "Chennai"])}[(page_id % 7 + 1)::INT] END"""


@query("rendered_page_locations", f"SELECT page_id, {SQL_PAGE_PLACE} AS location FROM pages WHERE page_id % 9 <> 8")
def rendered_page_locations(spark, sf_dir):
    p = rendered_pages(spark, sf_dir).filter(~pages.is_expired(F.col("page")))
    p = p.withColumn("lines", pages.lines_of(F.col("page")))
    return p.select("page_id", pages.location(F.col("lines"), F.col("url")).alias("location"))


@query(
    "usable_titles",
    rf"""SELECT page_id, NOT (length(t) < 2 OR starts_with(t, '#') OR contains(t, 'job description') OR contains(t, 'job details')
        OR regexp_matches(t, '{fixed.TITLE_ARTIFACT}') OR t IN ('job description', 'responsibilities', 'skills', 'salary')) AS usable
      FROM (SELECT page_id, lower({sql_pick(["Job Description", "SRE", "x", "## a", "Key Skills", "Responsibilities", "Salary", "1. Intro", "Full-time Nurse"], 'page_id')}) AS t FROM pages)""",
)
def usable_titles(spark, sf_dir):
    t = pick(["Job Description", "SRE", "x", "## a", "Key Skills", "Responsibilities", "Salary", "1. Intro", "Full-time Nurse"], F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", pages.is_usable_title(t).alias("usable"))


# --- scorer answers ---------------------------------------------------------------------


def answers(spark, sf_dir):
    """Model answers in four forms around the conversation text: plain, fenced, embedded, broken."""
    t, n = F.col("turn"), (F.col("conv_id") % 130).cast("string")
    words_ = F.to_json(F.struct(F.col("role").alias("role"), F.col("text").alias("line")))
    body = F.concat(
        F.lit('{"score": '), n, F.lit('.25, "reasons": ["a", "b"], "recommend": true, "queries": [" '), F.col("role"),
        F.lit(' engineer ", "", "aws sre"], "name": "N", "skills": ["x"], "experience": 4, "extra": '), words_, F.lit("}"),
    )
    answer = (
        F.when(t % 4 == 0, body).when(t % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(t % 4 == 2, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(F.concat(body, F.lit("}}")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", answer.alias("answer"))


@query(
    "scorer_answers",
    """SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN LEAST(100.0, conv_id % 130 + CASE WHEN conv_id % 130 >= 100 THEN 0 ELSE 0.2 END)::DOUBLE END AS score,
        CASE WHEN turn % 4 <> 3 THEN 'a,b' END AS reasons, CASE WHEN turn % 4 <> 3 THEN role || ' engineer,aws sre' END AS queries,
        CASE WHEN turn % 4 <> 3 THEN '4' END AS experience, CASE WHEN turn % 4 <> 3 THEN 'x' END AS skills FROM conversations""",
)
def scorer_answers(spark, sf_dir):
    a = answers(spark, sf_dir).select(
        "conv_id", "turn", scorer.parse_score(F.col("answer")).alias("s"), scorer.parse_list(F.col("answer"), "queries").alias("q"),
        scorer.parse_profile(F.col("answer")).alias("p"),
    )
    return a.select(
        "conv_id", "turn", F.col("s.score").alias("score"), F.array_join("s.reasons", ",").alias("reasons"),
        F.array_join("q", ",").alias("queries"), F.col("p.experience").alias("experience"), F.array_join("p.skills", ",").alias("skills"),
    )


@query(
    "scorer_verdicts",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN true END AS recommend, CASE WHEN role = 'user' THEN 'line ' || turn END AS line FROM conversations""",
)
def scorer_verdicts(spark, sf_dir):
    line = F.concat(F.lit(" line "), F.col("turn").cast("string"))
    flag = F.when(F.col("role") == "user", F.lit("true")).otherwise(F.lit('"yes"'))
    a = F.concat(F.lit('{"recommend": '), flag, F.lit(', "line": "'), line, F.lit('"}'))
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", scorer.parse_verdict(a).alias("v"))
    return v.select("conv_id", "turn", "v.recommend", "v.line")


@query(
    "prompt_rows",
    with_(POSTINGS, PROFILES, PAIRS, body="""SELECT profile_id, posting_id, '- Current Title: ' || COALESCE(nullif(p_title, ''), p_headline) || chr(10) ||
      '- Headline: ' || p_headline || chr(10) || '- Skills: ' || COALESCE(nullif(array_to_string(p_skills, ', '), ''), 'None specified') || chr(10) ||
      '- Experience: ' || COALESCE(nullif(p_experience, ''), 'Not specified') || ' years' || chr(10) || '- Summary: ' || chr(10) ||
      '- Preferred Location: ' || p_location || chr(10) || '- Title: ' || title || chr(10) || '- Company: ' || company || chr(10) ||
      '- Location: ' || location || chr(10) || '- Salary: ' || salary || chr(10) || '- Description: ' || description AS prompt_facts
      FROM pairs JOIN postings USING (posting_id) JOIN profiles USING (profile_id)"""),
)
def prompt_rows(spark, sf_dir):
    pairs = shapes.pairs(spark, sf_dir, shapes.postings(spark, sf_dir), shapes.profiles(spark, sf_dir).withColumn("p_summary", F.lit("")))
    return scorer.prompt_rows(pairs).select("profile_id", "posting_id", "prompt_facts")


@query(
    "plugged_scorer",
    with_(POSTINGS, PROFILES, PAIRS, body="""SELECT profile_id, posting_id, CASE WHEN posting_id % 100 < 99 THEN least(10 * (length(s) - length(replace(s, 'Engineer', ''))) / 8, 100)::DOUBLE END AS score
      FROM (SELECT *, COALESCE(nullif(p_title, ''), p_headline) || ' ' || p_headline || ' ' || array_to_string(p_skills, ' ') || ' ' || p_location || ' ' || title || ' '
        || company || ' ' || location || ' ' || salary || ' ' || description AS s FROM pairs JOIN postings USING (posting_id) JOIN profiles USING (profile_id))"""),
)
def plugged_scorer(spark, sf_dir):
    """A user scorer, several calls at a time: here the share of engineering words in the prompt. It fails on every hundredth posting."""

    def share(frame):
        if (frame["posting_id"] % 100 == 99).any():
            raise ValueError("no answer")
        n = frame["prompt_facts"].str.count("Engineer")
        return '{"score": ' + (n * 10).clip(0, 100).astype(str) + "}"

    asked = prompt_rows(spark, sf_dir)
    done = scorer.call_scorer(asked, share, rows_per_call=50, at_once=4)
    return done.select("profile_id", "posting_id", scorer.parse_score(F.col("answer"))["score"].alias("score"))


# --- profiles ------------------------------------------------------------------------------

LANGUAGES = ["Python", "Go", "", "C++", "Shell", "Terraform", "Jupyter Notebook", "Perl", "Java"]
TOPICS = ["kubernetes", "aws", "misc", "docker", "redis", "linux", "react", "graphql"]


def repositories(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (k % 40).alias("profile_id"), F.floor(k / 40).cast("bigint").alias("repo_no"), pick(LANGUAGES, k).alias("language"),
        F.array(pick(TOPICS, k), pick(TOPICS, F.floor(k / 7))).alias("topics"), F.col("p_size").alias("stars"),
    )


REPOS = f"""
repos AS (SELECT p_partkey % 40 AS profile_id, p_partkey // 40 AS repo_no, {sql_pick(LANGUAGES, 'p_partkey')} AS language,
  [{sql_pick(TOPICS, 'p_partkey')}, {sql_pick(TOPICS, 'p_partkey // 7')}] AS topics, p_size AS stars FROM part)"""


@query(
    "repository_skills",
    with_(
        REPOS, "langs(language, skill) AS (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in fixed.LANGUAGE_SKILLS.items()) + ")",
        f"""named AS (SELECT profile_id, repo_no, 0 AS pos, skill FROM repos JOIN langs ON lower(repos.language) = langs.language
          UNION ALL SELECT profile_id, repo_no, i, topics[i] FROM repos, (SELECT unnest([1, 2]) AS i) WHERE list_contains({sql_list(fixed.TOPIC_SKILLS)}, topics[i])),
        first_seen AS (SELECT profile_id, skill, min(repo_no * 10 + pos) AS place FROM named GROUP BY ALL)""",
        body="SELECT profile_id, string_agg(skill, ',' ORDER BY place) AS skills FROM first_seen GROUP BY profile_id",
    ),
)
def repository_skills(spark, sf_dir):
    found = profiles.repository_skills(repositories(spark, sf_dir))
    return found.select("profile_id", F.array_join("suggested", ",").alias("skills"))


@query(
    "top_repositories",
    with_(REPOS, body="""SELECT profile_id, repo_no, row_number() OVER (PARTITION BY profile_id ORDER BY stars DESC, repo_no) AS star_rank FROM repos"""),
)
def top_repositories(spark, sf_dir):
    return profiles.top_repositories(repositories(spark, sf_dir)).select("profile_id", "repo_no", "star_rank")


PROFILE_TITLES = ["Ann Lee - Cloud Engineer at X - Y | LinkedIn", "Bob | LinkedIn", "Cy - Dev", "dee"]
PROFILE_SNIPPETS = ["a devops engineer here", "Experience: Globex · Pune", "none", "Tech Lead"]


@query(
    "profile_from_hit",
    rf"""WITH t AS (SELECT c_custkey, {sql_pick(PROFILE_TITLES, 'c_custkey')} AS t, {sql_pick(PROFILE_SNIPPETS, 'c_custkey // 4')} AS s, c_name FROM customer)
      SELECT c_custkey, CASE WHEN contains(t, ' - ') THEN trim(string_split(t, ' - ')[1]) ELSE c_name END AS name,
        CASE WHEN contains(s, 'devops engineer') THEN 'devops engineer' WHEN s = 'Tech Lead' THEN s WHEN contains(s, 'Experience:') THEN 'Globex'
          WHEN contains(t, ' - ') AND contains(t, ' | ') THEN 'Cloud Engineer at X - Y' ELSE '' END AS headline FROM t""",
)
def profile_from_hit(spark, sf_dir):
    k = F.col("c_custkey")
    p = profiles.profile_from_hit(pick(PROFILE_TITLES, k), pick(PROFILE_SNIPPETS, F.floor(k / 4)), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.name", "p.headline")


@query(
    "run_defaults",
    with_(PROFILES, body="""SELECT profile_id, COALESCE(nullif(p_title, ''), nullif(p_headline, ''), 'engineer') AS query,
      COALESCE(nullif(p_location, ''), 'India') AS location, CASE WHEN profile_id % 3 = 0 THEN 7 ELSE (profile_id % 3)::INT END AS days FROM profiles"""),
)
def run_defaults(spark, sf_dir):
    k = F.col("profile_id")
    d = profiles.run_defaults(
        F.col("p_title"), F.col("p_headline"), F.col("p_location"), F.lit("engineer"), F.lit(""), F.lit("last"), F.lit("India"),
        F.when(k % 3 > 0, (k % 3).cast("int")), F.lit(7),
    )
    return shapes.profiles(spark, sf_dir).select("profile_id", d.alias("d")).select("profile_id", "d.query", "d.location", "d.days")


@query(
    "supplemented_profiles",
    with_(PROFILES, body="""SELECT profile_id, array_to_string(p_skills || ['go', 'rust'], ',') AS skills,
      COALESCE(nullif(p_title, ''), 'Engineer') AS title, COALESCE(nullif(p_experience, ''), '3') AS experience, p_headline AS headline,
      array_to_string(p_skills || list_filter(['aws', 'rust'], lambda s: NOT list_contains(p_skills, s)), ',') AS merged FROM profiles"""),
)
def supplemented_profiles(spark, sf_dir):
    p = shapes.profiles(spark, sf_dir)
    p = p.withColumn("merged", F.array_join(profiles.add_skills(F.col("p_skills"), F.array(F.lit("aws"), F.lit("rust"))), ","))
    out = profiles.supplement(p, F.lit("go, rust,"), F.lit("Engineer"), F.lit("3"), F.lit(""))
    return out.select(
        "profile_id", F.array_join("p_skills", ",").alias("skills"), F.col("p_title").alias("title"),
        F.col("p_experience").alias("experience"), F.col("p_headline").alias("headline"), "merged",
    )


