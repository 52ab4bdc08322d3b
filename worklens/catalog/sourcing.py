"""Queries of the source parsers and of the joins that enrich postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import enrich
from ..sources import hits as web
from ..sources import payloads, union
from . import shapes
from .extracting import (
    _BOARD, _COMPANY1, _COMPANY2, _HOST_COMPANY, _HOST_PARTS, _SKIP, _WEB, RAW_TITLES, SNIPPETS, SQL_PAGE_PLACE, rendered_pages, sql_company, sql_first, sql_page, sql_title_case,
)
from .filtering import (
    CRAWL, SQL_ALIVE, SQL_HOMEPAGE, SQL_SEARCH_PAGE, crawl, sql_alive, sql_any, sql_relevant, sql_snippet_old,
)
from .normalizing import CITY_KEYS, sql_city_map
from .registry import query
from .shapes import AS_OF, POSTINGS, as_of, pick, spread, sql_list, sql_pick, table, with_

PER_PAYLOAD = 25

# --- listing API ---------------------------------------------------------------------


def listing_payloads(spark, sf_dir):
    """Part rows wrapped into API answers of 25 rows behind the leading notice."""
    k = F.col("p_partkey")
    row = F.struct(
        F.col("p_name").alias("position"), F.col("p_brand").alias("company"),
        F.when(k % 5 == 0, "").otherwise("Berlin").alias("location"), F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.concat(F.lit("https://r/"), k.cast("string")).alias("url"), F.split(F.lower("p_type"), " ").alias("tags"),
        F.when(k % 4 > 0, (F.lit(AS_OF) - (k % 30) * 86400).cast("double")).alias("epoch"),
        F.when(k % 8 == 0, F.lit("2024-01-01")).alias("date"),
    )
    notice = '{"legal":"notice"}'
    rows = table(spark, sf_dir, "part").select(F.floor(k / PER_PAYLOAD).cast("bigint").alias("payload_id"), k.alias("k"), row.alias("r"))
    grouped = rows.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.to_json(x["r"])), ",")
    return grouped.select("payload_id", F.concat(F.lit(f"[{notice},"), body, F.lit("]")).alias("payload"))


@query(
    "listing_api_rows",
    f"""SELECT p_partkey // {PER_PAYLOAD} AS payload_id, (p_partkey % {PER_PAYLOAD} + 1)::INT AS position_no, trim(p_name) AS title, p_brand AS company,
        CASE WHEN p_partkey % 5 = 0 THEN 'Remote' ELSE 'Berlin' END AS location, p_name || ' ' || p_type AS description,
        'https://r/' || p_partkey AS url, CASE WHEN p_partkey % 4 > 0 THEN {AS_OF} - (p_partkey % 30) * 86400 END::DOUBLE AS epoch
      FROM part WHERE (CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 30 <= 14 ELSE p_partkey % 8 = 0 END)
        AND (list_has_any(['small', 'ring', 'economy'], regexp_extract_all(lower(p_name), '[a-z0-9+#.]+'))
          OR list_has_any(['small', 'ring', 'economy'], string_split(lower(p_type), ' ')))""",
)
def listing_api_rows(spark, sf_dir):
    rows = payloads.listing_api(listing_payloads(spark, sf_dir), F.lit("the small ring of economy"), 14, as_of())
    return rows.select("payload_id", "position_no", "title", "company", "location", "description", "url", "epoch")


# --- search-result pages ------------------------------------------------------------------


def serp_payloads(spark, sf_dir):
    k = F.col("p_partkey")
    s = k.cast("string")
    link = lambda head: F.concat(F.lit(head), s)
    google = link("https://www.google.com/search?q=")
    row = F.struct(
        F.col("p_name").alias("title"), F.col("p_brand").alias("company_name"), F.when(k % 3 > 0, F.lit("Pune")).alias("location"),
        F.col("p_type").alias("description"),
        F.when(k % 4 == 0, F.array(F.struct(google.alias("link")), F.struct(link("https://a/").alias("link"))))
        .when(k % 4 == 1, F.array(F.struct(google.alias("link")))).alias("apply_options"),
        F.when(k % 4 == 2, link("https://s/")).alias("source_link"), google.alias("share_link"),
        F.when(k % 3 == 0, F.struct(F.lit("3 days ago").alias("posted_at"))).alias("detected_extensions"),
        F.when(k % 3 == 1, F.array(F.lit("5 hours ago"), F.lit("Full-time"))).otherwise(F.array(F.lit("Full-time"))).alias("extensions"),
    )
    rows = table(spark, sf_dir, "part").select(F.floor(k / 10).cast("bigint").alias("payload_id"), k.alias("k"), row.alias("r"))
    grouped = rows.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.to_json(x["r"])), ",")
    full = F.concat(F.lit('{"jobs_results":['), body, F.lit("]}"))
    return grouped.select(
        "payload_id",
        F.when(F.col("payload_id") % 7 == 3, '{"error":"Invalid key"}').when(F.col("payload_id") % 7 == 4, '{"error":"Google hasn\'t returned any results"}')
        .otherwise(full).alias("payload"),
    )


@query(
    "serp_rows",
    f"""SELECT k // 10 AS payload_id, p_name AS title, p_brand AS company, CASE WHEN k % 3 > 0 THEN 'Pune' ELSE 'Remote' END AS location,
        CASE k % 4 WHEN 0 THEN 'https://a/' || k WHEN 2 THEN 'https://s/' || k ELSE 'https://www.google.com/search?q=' || k END AS url,
        CASE k % 3 WHEN 0 THEN '3 days ago' WHEN 1 THEN '5 hours ago' ELSE 'within week' END AS listed,
        CASE WHEN k % 3 = 2 THEN {AS_OF} - 7 * 86400 + 120 END AS listed_epoch
      FROM (SELECT *, p_partkey AS k FROM part) WHERE (k // 10) % 7 NOT IN (3, 4)""",
)
def serp_rows(spark, sf_dir):
    rows = payloads.serp(serp_payloads(spark, sf_dir), F.lit(7), as_of())
    return rows.select("payload_id", "title", "company", "location", "url", "listed", "listed_epoch")


@query(
    "payload_errors",
    "SELECT DISTINCT p_partkey // 10 AS payload_id, 'Invalid key' AS error FROM part WHERE (p_partkey // 10) % 7 = 3",
)
def payload_errors(spark, sf_dir):
    return payloads.payload_errors(serp_payloads(spark, sf_dir)).select("payload_id", "error")


# --- structured rows --------------------------------------------------------------------------


def row_payloads(spark, sf_dir):
    """Command outputs in five wrappings, with terminal codes and noise before the JSON."""
    k = F.col("p_partkey")
    s = k.cast("string")
    row = F.struct(
        F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("title"), F.col("p_brand").alias("company"),
        F.when(k % 4 > 0, F.lit("Pune ")).alias("location"), F.lit("₹10 LPA").alias("salary"), s.alias("id"),
        F.concat(F.lit("https://in.linkedin.com/jobs/view/x-"), (k + 5000000).cast("string"), F.lit("?p=1")).alias("url"),
        F.when(k % 2 == 0, F.lit("https://www.linkedin.com/job-apply/1")).otherwise(F.concat(F.lit("https://a/"), s)).alias("apply_url"),
        F.array("p_type").alias("tags"),
    )
    rows = table(spark, sf_dir, "part").select(F.floor(k / 20).cast("bigint").alias("payload_id"), k.alias("k"), row.alias("r"))
    grouped = rows.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("l"))
    body = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: F.to_json(x["r"])), ","), F.lit("]"))
    form = F.col("payload_id") % 5
    wrap = lambda name: F.concat(F.lit(f'{{"n": 1, "{name}": '), body, F.lit("}"))
    out = (
        F.when(form == 0, body).when(form == 1, F.concat(F.lit("\u001b[32mok\u001b[0m "), wrap("rows"))).when(form == 2, wrap("data"))
        .when(form == 3, wrap("results")).otherwise(F.concat(F.lit("log line\n"), wrap("items"), F.lit("\ntrailer")))
    )
    return grouped.select("payload_id", out.alias("payload"))


@query(
    "professional_rows",
    """SELECT k // 20 AS payload_id, (k % 20)::INT AS position_no, trim(p_name) AS title, p_brand AS company, CASE WHEN k % 4 > 0 THEN 'Pune' ELSE 'India' END AS location,
        'https://www.linkedin.com/jobs/view/' || (k + 5000000) AS url, '₹10 LPA' AS salary,
        CASE WHEN k % 2 = 0 THEN 'https://www.linkedin.com/jobs/view/' || (k + 5000000) ELSE 'https://a/' || k END AS apply_url
      FROM (SELECT *, p_partkey AS k FROM part) WHERE k % 6 > 0""",
)
def professional_rows(spark, sf_dir):
    rows = payloads.professional_rows(payloads.envelope(row_payloads(spark, sf_dir)))
    return rows.select("payload_id", "position_no", "title", "company", "location", "url", "salary", "apply_url")


@query(
    "board_rows",
    """SELECT k // 20 AS payload_id, trim(p_name) AS title, p_brand AS company, CASE WHEN k % 4 > 0 THEN 'Pune' ELSE 'India' END AS location,
        '₹10 LPA' AS description, k::VARCHAR AS job_key, p_type AS tags FROM (SELECT *, p_partkey AS k FROM part) WHERE k % 6 > 0""",
)
def board_rows(spark, sf_dir):
    rows = payloads.board_rows(payloads.envelope(row_payloads(spark, sf_dir)))
    return rows.select("payload_id", "title", "company", "location", "description", "job_key", F.array_join("tags", ",").alias("tags"))


@query(
    "recovered_titles",
    """WITH r AS (SELECT p_partkey AS k, p_partkey // 200 AS payload_id, p_partkey % 6 = 0 AS bare, p_name, p_brand FROM part)
      SELECT payload_id, k AS position_no, CASE WHEN bare AND k % 4 < 3 THEN 'Detail ' || k WHEN bare THEN ' ' ELSE p_name END AS title,
        CASE WHEN k % 5 > 0 THEN 'Pune' WHEN bare AND k % 4 < 3 THEN 'Delhi' ELSE '' END AS location FROM r""",
)
def recovered_titles(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.floor(k / 200).cast("bigint").alias("payload_id"), k.alias("position_no"), k.cast("string").alias("id"),
        F.when(k % 6 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(k % 5 > 0, "Pune").otherwise("").alias("location"),
        F.lit("").alias("salary"),
    )
    details = part.select(
        F.when(k % 4 < 3, k.cast("string")).otherwise(F.concat(F.lit("other-"), k.cast("string"))).alias("id"), F.concat(F.lit("Detail "), k.cast("string")).alias("title"), F.lit("Delhi").alias("location"),
        F.lit("₹1").alias("salary"), F.lit("").alias("description"), F.lit("").alias("job_type"),
    )
    return payloads.recover_titles(rows, details, ["payload_id"]).select("payload_id", "position_no", "title", "location")


# --- text blocks, feeds, cards --------------------------------------------------------------------


@query(
    "text_block_rows",
    """SELECT p_partkey // 10 AS payload_id, p_name || ' | ' || p_brand AS title, 'https://j/' || p_partkey AS url,
        CASE WHEN p_partkey % 3 = 1 THEN '2024-01-05T00:00:00.000Z' END AS "publishedDate", CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS author,
        CASE WHEN p_partkey % 3 < 2 THEN 'About ' || p_type || chr(10) || 'more' END AS text FROM part WHERE p_partkey % 11 > 0""",
)
def text_block_rows(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.concat(F.lit("Title: "), "p_name", F.lit(" | "), "p_brand", F.lit("\nURL: https://j/"), k.cast("string"))
    full = F.concat(
        head, F.lit("\nPublished: "), F.when(k % 3 == 1, "2024-01-05T00:00:00.000Z").otherwise("N/A"), F.lit("\nAuthor: "),
        F.when(k % 3 == 0, F.col("p_brand")).otherwise("N/A"), F.lit("\nHighlights:\nAbout "), "p_type", F.lit("\nmore\n"),
    )
    block = F.when(k % 11 == 0, "no title here").when(k % 3 == 2, head).otherwise(full)
    rows = table(spark, sf_dir, "part").select(F.floor(k / 10).cast("bigint").alias("payload_id"), k.alias("k"), block.alias("b"))
    grouped = rows.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("k", "b"))).alias("l"))
    p = grouped.select("payload_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n---\n").alias("payload"))
    return payloads.text_blocks(p).drop("position_no")


def feed_payloads(spark, sf_dir):
    """Part rows as feeds of 40 entries in three formats, dates in several zones; every seventh feed is broken."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    link = F.concat(F.lit("https://f/"), n)
    dated = pick(["Wed, 03 Jan 2024 10:00:00 GMT", "Wed, 03 Jan 2024 15:30:00 +0530", "Wed, 03 Jan 2024 05:00:00 EST", "no date"], k)
    creator = F.when(k % 5 == 0, F.concat(F.lit("<dc:creator>"), "p_brand", F.lit("</dc:creator>"))).otherwise("")
    item = F.concat(
        F.lit("<item><title>"), "p_name", F.lit("</title><link>"), link, F.lit("</link><description>"), "p_type", F.lit("</description>"), creator,
        F.lit("<pubDate>"), dated, F.lit("</pubDate></item>"),
    )
    entry = F.concat(
        F.lit('<entry><title type="text">'), "p_name", F.lit('</title><link rel="self" href="https://self/"/><link href="'), link, F.lit('"/><summary>'), "p_type",
        F.lit("</summary><updated>"), pick(["2024-01-03T10:00:00Z", "2024-01-03T15:30:00+05:30", "never"], k), F.lit("</updated></entry>"),
    )
    feed_no = F.floor(k % 500 / 40)
    rows = table(spark, sf_dir, "part").select(
        F.floor(k / 500).cast("bigint").alias("run_id"), feed_no.cast("bigint").alias("feed_no"), k.alias("k"), F.when(feed_no % 3 == 1, entry).otherwise(item).alias("i")
    )
    grouped = rows.groupBy("run_id", "feed_no").agg(F.array_sort(F.collect_list(F.struct("k", "i"))).alias("l"))
    body, no = F.array_join(F.transform("l", lambda x: x["i"]), ""), F.col("feed_no").cast("string")
    head = F.concat(F.lit("<title>Feed "), no, F.lit("</title>"))
    xml = (
        F.when((F.col("run_id") + F.col("feed_no")) % 7 == 6, F.concat(F.lit("<html>not a feed "), no, F.lit("</html>")))
        .when(F.col("feed_no") % 3 == 0, F.concat(F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'), head, body, F.lit("</channel></rss>")))
        .when(F.col("feed_no") % 3 == 1, F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">'), head, body, F.lit("</feed>")))
        .otherwise(F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'), head, F.lit("</channel>"), body, F.lit("</rdf:RDF>")))
    )
    return grouped.select("run_id", "feed_no", xml.alias("payload"))


@query(
    "feed_rows",
    """WITH e AS (SELECT p_partkey // 500 AS run_id, (p_partkey % 500) // 40 AS feed_no, p_partkey AS k, * FROM part),
      p AS (SELECT *, (row_number() OVER (PARTITION BY run_id, feed_no ORDER BY k) - 1)::INT AS position_no FROM e)
      SELECT run_id, feed_no, position_no, p_name AS title, CASE WHEN feed_no % 3 <> 1 AND k % 5 = 0 THEN p_brand ELSE 'Feed ' || feed_no END AS company, 'Pune' AS location,
        p_type AS description, 'https://f/' || k AS url, 'RSS' AS source,
        CASE WHEN feed_no % 3 = 1 THEN ['2024-01-03T10:00:00Z', '2024-01-03T15:30:00+05:30', 'never'][k % 3 + 1]
          ELSE ['Wed, 03 Jan 2024 10:00:00 GMT', 'Wed, 03 Jan 2024 15:30:00 +0530', 'Wed, 03 Jan 2024 05:00:00 EST', 'no date'][k % 4 + 1] END AS listed,
        CASE WHEN CASE WHEN feed_no % 3 = 1 THEN k % 3 < 2 ELSE k % 4 < 3 END THEN epoch(TIMESTAMP '2024-01-03 10:00:00')::BIGINT END AS listed_epoch,
        'rss' AS backend, 'partial' AS data_quality
      FROM p WHERE (run_id + feed_no) % 7 <> 6 AND (contains(lower(p_name || ' ' || p_type), 'small') OR contains(lower(p_name || ' ' || p_type), 'economy'))""",
)
def feed_rows(spark, sf_dir):
    return payloads.feed(feed_payloads(spark, sf_dir), F.lit("small economy"), F.lit("Pune"))


@query(
    "feed_errors",
    """SELECT DISTINCT p_partkey // 500 AS run_id, (p_partkey % 500) // 40 AS feed_no, 'unparseable feed (no recognized feed format)' AS error
      FROM part WHERE (p_partkey // 500 + (p_partkey % 500) // 40) % 7 = 6""",
)
def feed_errors(spark, sf_dir):
    return payloads.feed_errors(feed_payloads(spark, sf_dir))


def envelopes(spark, sf_dir):
    """Search envelopes: bare, nested, written as JSON inside a text, rendered as blocks; every ninth is an error or nested beyond all depth."""
    k = F.col("p_partkey")
    hit = F.struct(
        F.col("p_name").alias("title"), F.concat(F.lit("https://j/"), k.cast("string")).alias("url"), F.lit("2024-01-05").alias("publishedDate"),
        F.col("p_brand").alias("author"), F.col("p_type").alias("text"), F.lit(0.5).alias("score"),
    )
    bare = F.to_json(F.struct(F.lit("r").alias("requestId"), F.array(hit).alias("results")))
    content = lambda t: F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content")))
    block = F.concat(F.lit("Title: "), "p_name", F.lit(" | block\nURL: https://j/"), k.cast("string"))
    deep = F.concat(F.repeat(F.lit('{"a":'), F.lit(3000)), F.lit("1"), F.repeat(F.lit("}"), F.lit(3000)))
    payload = (
        F.when(k % 18 == 0, deep).when(k % 9 == 0, '{"success":false,"error":"limit"}').when(k % 4 == 0, F.concat(F.lit("\x1b[32m[INFO] fetched\x1b[0m "), bare))
        .when(k % 4 == 1, F.concat(F.lit('{"data":{"inner":'), bare, F.lit("}}"))).when(k % 4 == 2, content(bare)).otherwise(content(block))
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("k"), payload.alias("payload"))


@query(
    "nested_envelope_rows",
    """SELECT p_partkey AS k, p_name || CASE WHEN p_partkey % 4 = 3 THEN ' | block' ELSE '' END AS title, 'https://j/' || p_partkey AS url,
        CASE WHEN p_partkey % 4 < 3 THEN '2024-01-05' END AS "publishedDate", CASE WHEN p_partkey % 4 < 3 THEN p_brand END AS author,
        CASE WHEN p_partkey % 4 < 3 THEN p_type END AS text, CASE WHEN p_partkey % 4 < 3 THEN 0.5::DOUBLE END AS score
      FROM part WHERE p_partkey % 9 > 0""",
)
def nested_envelope_rows(spark, sf_dir):
    return payloads.semantic_results(envelopes(spark, sf_dir)).select("k", "title", "url", "publishedDate", "author", "text", "score")


@query(
    "search_card_rows",
    """SELECT 'professional' AS kind, p_partkey AS k, p_name AS title, p_brand AS company, 'Pune' AS location, '' AS description,
        'https://www.linkedin.com/jobs/view/' || (p_partkey + 1000000) AS url FROM part
      UNION ALL SELECT 'board', p_partkey, p_name, p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'Pune' ELSE 'India' END,
        CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || ' | ₹10' END, 'https://in.indeed.com/viewjob?jk=a' || p_partkey FROM part""",
)
def search_card_rows(spark, sf_dir):
    k = F.col("p_partkey")
    s, n = k.cast("string"), (k + 1000000).cast("string")
    one = F.concat(
        F.lit('<ul><li><div><h3 class="base-search-card__title"> '), "p_name", F.lit(' </h3><h4 class="base-search-card__subtitle"><a>'), "p_brand",
        F.lit('</a></h4><span class="job-search-card__location">Pune</span><a class="base-card__full-link" href="https://in.linkedin.com/jobs/view/x-'),
        n, F.lit('?position=1">go</a></div></li><li><p>no title</p></li></ul>'),
    )
    named = F.when(k % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit('<span title="t">'), "p_name", F.lit("</span>")))
    link = F.when(k % 5 == 0, '<a href="/rc/clk?jk=a').otherwise('<a class="jcs-JobTitle" href="/rc/clk?jk=a')
    two = F.concat(
        F.lit('<div class="job_seen_beacon">'), F.when(k % 3 == 1, '<span title="badge">Urgent</span>').otherwise(""), F.lit('<h3 class="jobTitle">'), link, s, F.lit('&from=x">'), named,
        F.lit('</a></h3><span data-testid="company-name">'), "p_brand", F.lit("</span>"),
        F.when(k % 4 == 0, '<span title="New">New</span></p></b>').otherwise(""), F.when(k % 2 == 0, '<div data-testid="text-location">Pune</div>').otherwise(""),
        F.when(k % 3 > 0, '<div data-testid="x-salary">₹10</div>').otherwise(""), F.lit('<div class="job-snippet"><br>'), "p_type", F.lit("</div></div>"),
    )
    part = spread(table(spark, sf_dir, "part"), "p_partkey")
    cols = ["kind", "k", "title", "company", "location", "description", "url"]
    a = payloads.cards(part.select(k.alias("k"), one.alias("payload")), "professional").withColumn("kind", F.lit("professional")).select(cols)
    b = payloads.cards(part.select(k.alias("k"), two.alias("payload")), "board").withColumn("kind", F.lit("board")).select(cols)
    return a.unionByName(b)


# --- hits ------------------------------------------------------------------------------------------


def hit_rows(spark, sf_dir):
    """Hits of site-query runs: 50 pages a run, ten a site query."""
    k = F.col("page_id")
    site = F.regexp_extract("url", r"^https?://[^/]+", 0)
    body = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")
    href = F.concat(site, pick(["/jobs/12", "/careers/devops-engineer", "", "/search?q=x", "/login", "/p/1"], k))
    return table(spark, sf_dir, "pages").select(
        F.floor(k / 50).cast("bigint").alias("run_id"), F.floor(k % 50 / 10).cast("bigint").alias("site_no"), k.alias("hit_id"),
        pick(RAW_TITLES, k).alias("title"), href.alias("href"), F.concat_ws(" ", pick(SNIPPETS, k), body).alias("body"),
    )


HIT_ROWS = rf"""
hit_rows AS (SELECT page_id // 50 AS run_id, page_id % 50 // 10 AS site_no, page_id AS hit_id, {sql_pick(RAW_TITLES, 'page_id')} AS title,
  regexp_extract(url, '^https?://[^/]+') || {sql_pick(["/jobs/12", "/careers/devops-engineer", "", "/search?q=x", "/login", "/p/1"], 'page_id')} AS href,
  {sql_pick(SNIPPETS, 'page_id')} || ' ' || regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') AS body FROM pages),
gated AS (SELECT * FROM hit_rows WHERE title <> '' AND NOT ({SQL_HOMEPAGE}) AND NOT {SQL_SEARCH_PAGE}
  AND NOT {sql_any('href', fixed.NON_POSTING_URLS)} AND NOT {sql_any('title', fixed.NON_POSTING_TITLES)}
  AND {sql_relevant('title', ['devops', 'engineer', 'pune'])} AND NOT {sql_snippet_old('body', 7)})"""


def _sql_hits(cleaned: str) -> str:
    return HIT_ROWS + f""",
pre AS (SELECT *, {_BOARD} AS board FROM gated),
cleaned AS (SELECT run_id, site_no, hit_id, title AS raw_title, {cleaned} AS title, href, body FROM pre),
named AS (SELECT * FROM cleaned WHERE title <> '' AND NOT {SQL_SEARCH_PAGE}),
taken AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY run_id, href ORDER BY hit_id) = 1)"""


def _sql_places(everything: str) -> str:
    """Places of the rows of ``taken``: a known city anywhere in them."""
    return f"spoken AS (SELECT *, {everything} AS everything FROM taken), " + CITY_KEYS + "," + sql_city_map("m", "spoken", "everything", tuple(fixed.FREE_TEXT_EXCLUDED), False)


_PLACE = "CASE WHEN m.city <> '' THEN m.city ELSE 'Remote / Unspecified' END AS location"
_NAMED = r"""named_by AS (SELECT *, body AS snippet, list_filter(string_split(regexp_replace(lower(regexp_extract(href, '^https?://([^/]+)', 1)), '^www[0-9]*\.', ''), '.'),
  lambda x: NOT list_contains(""" + _SKIP + r""", x))[1] AS label FROM spoken)"""
_COMPANY = f"""COALESCE({sql_company(_COMPANY1)}, {sql_company(_COMPANY2)},
  nullif(trim(regexp_extract(raw_title, '^([A-Z][A-Za-z0-9\\s&.]+?)\\s+(?:is\\s+)?hiring\\s+', 1, 'i')), ''), {sql_title_case('label')}) AS company"""


@query(
    "keyword_hits",
    with_(_sql_hits(sql_first(_WEB)), _sql_places("raw_title || ' ' || href || ' ' || body"), _NAMED,
        body=f"SELECT run_id, hit_id, title, href AS url, body AS description, {_COMPANY}, {_PLACE} FROM named_by n LEFT JOIN m ON n.everything = m.raw"),
)
def keyword_hits(spark, sf_dir):
    rows = web.web_keyword(hit_rows(spark, sf_dir), F.lit("DevOps Engineer"), F.lit("Pune"), 7, as_of(), ["run_id"])
    return rows.select("run_id", "hit_id", "title", "url", "description", "company", "location")


def companies(spark, sf_dir):
    """Company dimension from the suppliers; the domains are suffixes of the page hosts by rule."""
    site = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/]+)", 1), r"^www\.", "")
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        k.alias("ord"), F.concat(F.lit("Company "), k.cast("string")).alias("company"),
        F.when(k % 3 == 0, F.concat(F.lit("www."), site)).when(k % 3 == 1, F.concat(F.lit("careers."), site))
        .otherwise(F.concat(F.lit("unmet-"), k.cast("string"), F.lit(".example"))).alias("domain"),
    )


COMPANIES = r"""
companies AS (SELECT page_id AS ord, 'Company ' || page_id AS company,
  CASE WHEN page_id % 3 = 2 THEN 'unmet-' || page_id || '.example' ELSE CASE WHEN page_id % 3 = 0 THEN '' ELSE 'careers.' END
    || regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\.', '') END AS domain FROM pages),
hosts AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www\.', '') AS host FROM pages),
owners AS (SELECT host, first(company ORDER BY ord) AS company FROM hosts JOIN companies
  ON host = domain OR ends_with(host, '.' || domain) OR ends_with(domain, '.' || host) GROUP BY host)"""


@query(
    "company_by_domain",
    with_(COMPANIES, body=r"""SELECT page_id, COALESCE(o.company, upper(l[1]) || substr(l, 2)) AS company
      FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www\.', '') AS h,
        string_split(regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www\.', ''), '.')[1] AS l FROM pages)
      LEFT JOIN owners o ON o.host = h"""),
)
def company_by_domain(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return enrich.company_by_domain(p, companies(spark, sf_dir)).select("page_id", "company")


@query(
    "board_hits",
    with_(COMPANIES, _sql_hits(sql_first("board")), _sql_places("raw_title || ' ' || body"), body=rf"""SELECT run_id, hit_id, title, href AS url, o.company, body AS description, {_PLACE} FROM spoken LEFT JOIN m ON everything = m.raw
      LEFT JOIN owners o ON o.host = regexp_replace(lower(regexp_extract(href, '^https?://([^/]+)', 1)), '^www\.', '')"""),
)
def board_hits(spark, sf_dir):
    rows = web.career_boards(
        hit_rows(spark, sf_dir), companies(spark, sf_dir), F.lit("DevOps Engineer"), F.lit("Pune"), 7, as_of(), ["run_id"]
    )
    return rows.select("run_id", "hit_id", "title", "url", "company", "description", "location")


def verdicts(crawled):
    """Crawl results in the order in which they came, which is that of the pages: of a url that was crawled again the last one counts."""
    return crawled.select("url", "status", "final_url", "body", F.col("page_id").alias("landed_at"))


@query(
    "semantic_hits",
    with_(CRAWL, f"""raw AS (SELECT page_id, {sql_pick(RAW_TITLES, 'page_id')} AS title, url AS href, url, status, final_url, body,
        CASE page_id % 3 WHEN 0 THEN '2024-01-29T10:00:00Z' WHEN 1 THEN '2023-12-01' ELSE '' END AS published FROM crawl),
      pre AS (SELECT *, {_BOARD} AS board FROM raw), named AS (SELECT * REPLACE ({sql_first(_WEB)} AS title) FROM pre),
      l AS (SELECT *, string_split(regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www[0-9]*\\.', ''), '.') AS l FROM named),
      spoken AS (SELECT *, title || ' ' || url || ' ' || body AS everything, {_HOST_PARTS} FROM l)""",
        CITY_KEYS, sql_city_map("m", "spoken", "everything", tuple(fixed.FREE_TEXT_EXCLUDED), False),
        body=f"""SELECT page_id AS hit_id, title, url, substr(published, 1, 10) AS listed, page_id / 100 AS score, body AS description,
          COALESCE(nullif({_HOST_COMPANY}, ''), 'N') AS company, {_PLACE} FROM spoken LEFT JOIN m ON everything = m.raw WHERE title <> '' AND NOT ({SQL_HOMEPAGE})
          AND {sql_relevant('title', ['devops', 'engineer', 'pune'])} AND NOT {sql_any('title', fixed.NON_POSTING_TITLES)}
          AND page_id % 3 <> 1 AND {SQL_ALIVE}"""),
)
def semantic_hits(spark, sf_dir):
    c = crawl(spark, sf_dir)
    k = F.col("page_id")
    rows = c.select(
        F.lit(1).alias("run_id"), k.alias("hit_id"), pick(RAW_TITLES, k).alias("title"), "url", F.col("body").alias("text"),
        F.when(k % 3 == 0, "2024-01-29T10:00:00Z").when(k % 3 == 1, "2023-12-01").otherwise("").alias("publishedDate"),
        F.lit("N").alias("author"), (k / 100).alias("score"),
    )
    out = web.web_semantic(rows, verdicts(c), F.lit("DevOps Engineer"), F.lit("Pune"), 7, as_of(), ["run_id"])
    return out.select("hit_id", "title", "url", "listed", "score", "description", "company", "location")


@query("live_postings", with_(CRAWL, body=f"SELECT page_id FROM crawl WHERE {sql_alive('body')}"))
def live_postings(spark, sf_dir):
    c = crawl(spark, sf_dir)
    return enrich.live_only(c.select("page_id", "url"), verdicts(c)).select("page_id")


PORTAL_PATHS = [
    "https://www.naukri.com/job-listings-python-developer-varite-pune-8-to-13-years-", "https://www.naukri.com/python-jobs-in-pune-",
    "https://www.naukri.com/campus/job-listings-", "https://other.com/job-listings-", "https://www.Naukri.com/job-listings-sre-acme-",
]
PORTAL_TITLES = ["Python Developer - Naukri.com", "SRE | Naukri.com", "Apply now", "naukri jobs", "Data Analyst - 3 Vacancies", "Search x"]


@query(
    "portal_hits",
    rf"""WITH h AS (SELECT page_id AS k, {sql_pick(SNIPPETS, 'page_id')} AS snippet, {sql_pick(PORTAL_TITLES, 'page_id')} AS title, {sql_pick(PORTAL_PATHS, 'page_id')} || (page_id // 10) AS href FROM pages),
      g AS (SELECT * FROM h WHERE contains(lower(href), 'naukri.com') AND contains(href, '/job-listings-') AND NOT contains(href, '/campus/')
        AND NOT {sql_any('title', fixed.NON_POSTING_TITLES)} QUALIFY row_number() OVER (PARTITION BY href ORDER BY k) = 1),
      m AS (SELECT *, trim(regexp_extract(snippet, 'in\s+([A-Z][a-zA-Z\s]+(?:,\s*[A-Z]{{2}})?)', 1, 'i')) AS a,
        trim(regexp_extract(snippet, '([A-Z][a-zA-Z\s]+(?:,\s*[A-Z]{{2}}))(?:\s+[.…]|\s*$)', 1, 'i')) AS b,
        replace(regexp_extract(href, '{fixed.PORTAL_SLUG_COMPANY}', 1), '-', ' ') AS slug FROM g)
      SELECT k AS hit_id, href AS url, snippet AS description,
        CASE WHEN a <> '' AND length(a) < 30 THEN a WHEN b <> '' AND length(b) < 30 THEN b ELSE 'Pune' END AS location,
        COALESCE({sql_company(_COMPANY1)}, {sql_company(_COMPANY2)}, {sql_title_case('slug')}) AS company, CASE title WHEN 'Python Developer - Naukri.com' THEN 'Python Developer' WHEN 'SRE | Naukri.com' THEN 'SRE'
        WHEN 'Data Analyst - 3 Vacancies' THEN 'Data Analyst' ELSE CASE WHEN contains(href, 'varite') THEN 'Python Developer Varite Pune' ELSE 'Sre Acme' END END AS title FROM m""",
)
def portal_hits(spark, sf_dir):
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        F.lit(1).alias("run_id"), k.alias("hit_id"), pick(PORTAL_TITLES, k).alias("title"),
        F.concat(pick(PORTAL_PATHS, k), F.floor(k / 10).cast("string")).alias("href"), pick(SNIPPETS, k).alias("body"),
    )
    return web.portal(rows, F.lit("Pune"), ["run_id"]).select("hit_id", "url", "title", "company", "location", "description")


SITE_TITLES = ["SRE - Acme - Pune - MH - Indeed.com", "Data Analyst | Noida", "Platform Engineer", "Lead – The Firm – Goa - Indeed"]


@query(
    "site_restricted_hits",
    f"""SELECT page_id AS hit_id, {sql_list(["SRE", "Data Analyst", "Platform Engineer", "Lead"])}[(page_id % 4 + 1)::INT] AS title,
        CASE WHEN page_id % 3 = 0 THEN 'Globex Corp' ELSE {sql_list(["Acme", "Unknown", "Unknown", "Unknown"])}[(page_id % 4 + 1)::INT] END AS company,
        {sql_list(["Pune - MH", "Noida", "India", "Goa"])}[(page_id % 4 + 1)::INT] AS location FROM pages""",
)
def site_restricted_hits(spark, sf_dir):
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        k.alias("hit_id"), pick(SITE_TITLES, k).alias("title"), F.concat(F.lit("https://in.indeed.com/viewjob?jk="), k.cast("string")).alias("href"),
        pick(["work at Globex Corp - now", "", "by The End"], k).alias("body"),
    )
    return web.site_restricted(rows, F.lit(""), []).select("hit_id", "title", "company", "location")


@query(
    "text_locations",
    with_(f"t AS (SELECT c_custkey, {sql_pick(SNIPPETS, 'c_custkey')} AS s FROM customer)", CITY_KEYS, sql_city_map("m", "t", "s", tuple(fixed.FREE_TEXT_EXCLUDED), False),
        body="SELECT c_custkey, CASE WHEN m.city <> '' THEN m.city ELSE 'Remote / Unspecified' END AS location FROM t JOIN m ON t.s = m.raw"),
)
def text_locations(spark, sf_dir):
    from ..functions.extract import location_from_text

    s = pick(SNIPPETS, F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", location_from_text(s, s).alias("location"))


# --- posting pages ------------------------------------------------------------------------------------


def posting_pages(spark, sf_dir):
    """Landed posting pages: linked data, application state, rendered text, expired."""
    k = F.col("page_id")
    body = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")
    salary = F.struct(F.lit("INR").alias("currency"), F.struct((k % 40).cast("string").alias("value")).alias("value"))
    address = F.struct(F.lit("Pune").alias("addressLocality"), F.lit("").alias("addressRegion"), F.lit("IN").alias("addressCountry"))
    ld = F.to_json(
        F.struct(
            F.lit("JobPosting").alias("@type"), F.lit(" Python Developer").alias("title"), body.alias("description"), F.lit("2024-01-05T01:00").alias("datePosted"),
            F.struct(F.concat(F.lit("Org "), (k % 3).cast("string")).alias("name")).alias("hiringOrganization"), F.struct(address.alias("address")).alias("jobLocation"),
            salary.alias("baseSalary"), F.array(F.lit("Python"), F.lit("AWS")).alias("skills"), F.lit("https://apply/x").alias("url"),
        )
    )
    state = F.to_json(
        F.struct(F.array(F.struct(F.lit(1).alias("x"))).alias("list"), F.struct(F.array(F.struct(
            F.lit("Data Engineer").alias("jobTitle"), body.alias("jobDescription"), F.lit("Acme").alias("companyName"),
            F.struct(F.struct(F.lit("Hyderabad").alias("addressLocality"), F.lit("TS").alias("addressRegion")).alias("address")).alias("location"),
            F.when(k % 2 == 0, 3).otherwise(0).alias("minExperience"), F.lit(6).alias("maxExperience"), F.array(F.lit("Spark"), F.lit("SQL")).alias("keySkills"),
            F.lit("2024-01-07").alias("createdDate"))).alias("jobs")).alias("props"))
    )
    kind = pick(['"application/ld+json"', "'application/ld+json'", "application/ld+json"], F.floor(k / 3).cast("bigint"))
    ld_page = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"Org"}</script><script type='), kind, F.lit(">"), ld, F.lit("</script></html>"))
    state_page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script></html>"))
    text_pages = rendered_pages(spark, sf_dir)
    return table(spark, sf_dir, "pages").join(text_pages.select("page_id", F.col("url").alias("job_url"), "page"), "page_id").select(
        "page_id", F.col("job_url").alias("url"), F.when(k % 3 == 0, ld_page).when(k % 3 == 1, state_page).otherwise(F.col("page")).alias("payload")
    )


#: Fields of a posting page by its kind: linked data, application state, rendered text.
SQL_POSTING_PAGE = rf"""SELECT page_id, expired,
    CASE page_id % 3 WHEN 0 THEN 'Python Developer' WHEN 1 THEN 'Data Engineer' ELSE title END AS title,
    CASE page_id % 3 WHEN 0 THEN 'Org 0' WHEN 1 THEN 'Acme' ELSE company END AS company,
    CASE page_id % 3 WHEN 0 THEN 'Pune, IN' WHEN 1 THEN 'Hyderabad, TS' ELSE CASE WHEN NOT expired THEN {SQL_PAGE_PLACE} END END AS location,
    CASE page_id % 3 WHEN 0 THEN 'INR ' || (page_id % 40) WHEN 1 THEN '' ELSE salary END AS salary,
    CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN '3-6' ELSE '6' END ELSE experience END AS experience,
    CASE page_id % 3 WHEN 0 THEN 'Python, AWS' WHEN 1 THEN 'Spark, SQL' ELSE keyskills END AS keyskills,
    CASE page_id % 3 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '2024-01-07' ELSE listed END AS listed,
    CASE WHEN page_id % 3 < 2 THEN body ELSE description END AS description,
    CASE page_id % 3 WHEN 0 THEN 'https://apply/x' WHEN 1 THEN '' ELSE apply_url END AS apply_url
  FROM ({sql_page()}) JOIN (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages) USING (page_id)"""


@query("posting_page_fields", SQL_POSTING_PAGE)
def posting_page_fields(spark, sf_dir):
    p = payloads.posting_page(posting_pages(spark, sf_dir))
    return p.select("page_id", "expired", "page.*")


@query(
    "page_merge",
    f"""WITH f AS ({SQL_POSTING_PAGE}), t AS (SELECT *, page_id % 5 < 4 AS hit FROM f)
      SELECT page_id AS posting_id, CASE WHEN hit THEN title ELSE 'snippet title' END AS title, CASE WHEN hit THEN 'full' ELSE 'snippet' END AS data_quality,
        CASE WHEN NOT hit THEN 'job page fetch/parse failed' END AS enrich_error, CASE WHEN hit THEN company ELSE '' END AS company,
        CASE WHEN hit AND location <> '' THEN location ELSE 'Pune' END AS location, CASE WHEN hit THEN description ELSE 's' END AS description,
        CASE WHEN hit THEN nullif(salary, '') END AS salary, CASE WHEN hit THEN nullif(experience, '') END AS experience, CASE WHEN hit THEN keyskills END AS keyskills,
        CASE WHEN hit THEN nullif(listed, '') END AS listed, CASE WHEN hit THEN nullif(apply_url, '') END AS apply_url,
        CASE WHEN hit THEN 'job-page' ELSE 'ddgs' END AS backend, CASE WHEN hit THEN 'job-page' END AS enrich_source
      FROM t WHERE NOT (hit AND expired)""",
)
def page_merge(spark, sf_dir):
    pages_ = posting_pages(spark, sf_dir)
    missed = F.when(F.col("page_id") % 5 == 4, F.concat("url", F.lit("?other"))).otherwise(F.col("url"))
    parsed = payloads.posting_page(pages_).withColumn("url", missed)
    rows = pages_.select(
        F.col("page_id").alias("posting_id"), F.floor(F.col("page_id") / 20).alias("batch"), "url", F.lit("snippet title").alias("title"),
        F.lit("").alias("company"), F.lit("Pune").alias("location"), F.lit("s").alias("description"), F.lit("snippet").alias("data_quality"),
        F.lit("ddgs").alias("backend"),
    )
    return enrich.page_fields(rows, parsed.select("url", "expired", "page"), ["batch"]).select(
        "posting_id", "title", "data_quality", "enrich_error", "company", "location", "description", "salary", "experience", "keyskills", "listed", "apply_url", "backend", "enrich_source"
    )


# --- detail joins, union -----------------------------------------------------------------------------


def networked(spark, sf_dir):
    """Postings with network and board sources and links a detail row can be found by."""
    k = F.col("posting_id")
    p = shapes.postings(spark, sf_dir).drop("source", "job_key")
    link = F.concat(F.lit("https://in.linkedin.com/jobs/view/x-"), (k + 1000000).cast("string"), F.lit("?p=2"))
    return p.withColumns(
        {
            "source": pick(["LinkedIn", "Indeed", "Naukri"], k), "url": F.when(k % 3 == 0, link).otherwise(F.col("url")),
            "job_key": F.when(k % 3 == 1, k.cast("string")), "apply_url": F.lit("old"), "job_type": F.lit(""), "applicants": F.lit(""),
            "company_url": F.lit(""),
        }
    )


def details(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("https://www.linkedin.com/jobs/view/"), (k + 1000000).cast("string")).alias("url"), k.cast("string").alias("job_key"),
        F.concat(F.lit("detail "), k.cast("string")).alias("description"), F.lit("https://www.linkedin.com/job-apply/77").alias("apply_url"),
        F.when(F.col("quality") == 1, "Remote").otherwise("").alias("workplace_type"), F.lit("Full-time").alias("job_type"), F.lit("9").alias("applicants"),
        F.lit("").alias("listed"), F.lit("https://c").alias("company_url"), F.lit("₹99 LPA").alias("salary"),
    )


@query(
    "network_details",
    with_(POSTINGS, body="""SELECT posting_id, CASE WHEN hit THEN 'detail ' || posting_id ELSE p.description END AS description, p.salary,
        CASE WHEN hit AND quality = 1 THEN 'Remote' ELSE p.workplace_type END AS workplace_type,
        CASE WHEN hit THEN 'https://in.linkedin.com/jobs/view/x-' || (posting_id + 1000000) || '?p=2' ELSE 'old' END AS apply_url,
        CASE WHEN hit THEN 'full' ELSE p.data_quality END AS data_quality,
        CASE WHEN posting_id % 3 = 0 AND NOT hit THEN 'job-detail failed' END AS enrich_error
      FROM (SELECT p.*, l.quality, posting_id % 3 = 0 AND l.doc_id IS NOT NULL AS hit FROM postings p LEFT JOIN labels l ON l.doc_id = p.posting_id) p"""),
)
def network_details(spark, sf_dir):
    return enrich.professional_details(networked(spark, sf_dir), details(spark, sf_dir)).select(
        "posting_id", "description", "salary", "workplace_type", "apply_url", "data_quality", "enrich_error"
    )


@query(
    "board_details",
    with_(POSTINGS, body="""SELECT posting_id, CASE WHEN hit THEN 'detail ' || posting_id ELSE p.description END AS description,
        CASE WHEN hit THEN '₹99 LPA' ELSE p.salary END AS salary, CASE WHEN hit THEN 'full' ELSE p.data_quality END AS data_quality,
        CASE WHEN posting_id % 3 = 1 AND NOT hit THEN 'job detail failed' END AS enrich_error
      FROM (SELECT p.*, posting_id % 3 = 1 AND l.doc_id IS NOT NULL AS hit FROM postings p LEFT JOIN labels l ON l.doc_id = p.posting_id) p"""),
)
def board_details(spark, sf_dir):
    return enrich.board_details(networked(spark, sf_dir), details(spark, sf_dir)).select(
        "posting_id", "description", "salary", "data_quality", "enrich_error"
    )


@query(
    "rendered_fallback",
    with_(POSTINGS, """ m AS (SELECT r.*, posting_id % 3 = 0 AND l.doc_id IS NOT NULL AS hit FROM postings r LEFT JOIN labels l ON l.doc_id = r.posting_id)""",
        body="""SELECT posting_id, CASE WHEN hit THEN 'page ' || posting_id ELSE description END AS description,
          CASE WHEN hit THEN 'partial' ELSE data_quality END AS data_quality FROM m"""),
)
def rendered_fallback(spark, sf_dir):
    from ..operators.rank import full_rank

    rows = networked(spark, sf_dir).withColumns({"profile_id": F.col("posting_id") % 4, "score": F.lit(1.0)})
    ranks = full_rank(rows.select("profile_id", "posting_id", "score"), ["profile_id"]).select("posting_id", "rank")
    rendered = details(spark, sf_dir).select("url", F.concat(F.lit(" page "), "job_key").alias("page"))
    return enrich.rendered_fallback(rows.join(ranks, "posting_id"), rendered).select("posting_id", "description", "data_quality")


@query(
    "batch_quality",
    """SELECT page_id // 20 AS batch, CASE WHEN bool_or(page_id % 7 = 0) THEN 'full' WHEN bool_or(page_id % 7 = 1) THEN 'partial' ELSE 'snippet' END AS data_quality,
        count(*) FILTER (page_id % 7 = 0) AS n_enriched FROM pages GROUP BY ALL""",
)
def batch_quality(spark, sf_dir):
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        F.floor(k / 20).cast("bigint").alias("batch"), F.when(k % 7 == 0, "full").when(k % 7 == 1, "partial").otherwise("snippet").alias("data_quality"),
        F.when(k % 7 == 0, "job-page").alias("enrich_source"),
    )
    return enrich.batch_quality(rows, ["batch"])


@query(
    "source_union",
    with_(POSTINGS, body="""SELECT source, title, url, COALESCE(data_quality, 'snippet') AS data_quality, 'landed' AS backend FROM postings
      UNION ALL SELECT 'LinkedIn', trim(p_name), 'https://www.linkedin.com/jobs/view/' || (p_partkey + 5000000), 'partial', 'opencli' FROM part WHERE p_partkey % 6 > 0"""),
)
def source_union(spark, sf_dir):
    rows = payloads.professional_rows(payloads.envelope(row_payloads(spark, sf_dir)))
    both = union.union([(shapes.postings(spark, sf_dir), "snippet", "landed"), (rows, "full", "other")])
    return both.select("source", "title", "url", "data_quality", "backend")


