"""Queries of duplicate removal and string similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import similarity, words
from ..operators import dedup, kept, scorer
from ..session import shared_folder
from . import shapes
from .extracting import answers
from .registry import ORACLE, query
from .shapes import POSTINGS, pick, table, with_
from .tracking import run_queries

#: Batches in which postings reach the index of kept ones.
BATCHES = 3


@query(
    "first_per_url",
    with_(POSTINGS, body="SELECT url, min(posting_id) AS posting_id FROM postings GROUP BY url"),
)
def first_per_url(spark, sf_dir):
    return dedup.exact_url(shapes.postings(spark, sf_dir)).select("url", "posting_id")


@query(
    "first_per_title_company",
    with_(POSTINGS, body="""SELECT posting_id, title, company, url FROM postings QUALIFY
      row_number() OVER (PARTITION BY lower(title), lower(company) ORDER BY posting_id) = 1"""),
)
def first_per_title_company(spark, sf_dir):
    return dedup.exact_title_company(shapes.postings(spark, sf_dir)).select("posting_id", "title", "company", "url")


_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '\b(ii|iii|iv|sr?|jr)\b', '', 'g'),
  '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"""


@query(
    "name_similarity",
    f"""WITH RECURSIVE {POSTINGS.strip()},
    pairs AS (SELECT a.posting_id, {_KEY.format(x='a.title')} AS t1, {_KEY.format(x='b.title')} AS t2,
        {_KEY.format(x='a.company')} AS c1, {_KEY.format(x='b.company')} AS c2
      FROM postings a JOIN postings b ON b.posting_id = a.posting_id + 1),
    cut AS (SELECT *, list_sort(string_split(t1, ' ')) AS x, list_sort(string_split(t2, ' ')) AS y,
        list_sort(list_distinct(string_split(c1, ' '))) AS p, list_sort(list_distinct(string_split(c2, ' '))) AS q FROM pairs),
    sets AS (SELECT posting_id, c1, c2, array_to_string(x, ' ') AS a, array_to_string(y, ' ') AS b,
        array_to_string(list_filter(p, lambda w: list_contains(q, w)), ' ') AS common,
        array_to_string(list_filter(p, lambda w: NOT list_contains(q, w)), ' ') AS r1,
        array_to_string(list_filter(q, lambda w: NOT list_contains(p, w)), ' ') AS r2 FROM cut),
    todo AS (SELECT a, b FROM sets UNION SELECT r1, r2 FROM sets),
    steps(a, b, i, dp) AS (
      SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0) FROM todo
      UNION ALL
      SELECT a, b, i + 1, [0] || list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: GREATEST(dp[k + 1], CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN dp[k] + 1 ELSE 0 END))))
      FROM steps WHERE i < length(a)),
    lcs AS (SELECT a, b, dp[-1] AS n FROM steps WHERE i = length(a)),
    scored AS (SELECT s.*, l1.n AS n1, l2.n AS n2, length(common) + CASE WHEN common <> '' THEN 1 ELSE 0 END AS base
      FROM sets s JOIN lcs l1 ON l1.a = s.a AND l1.b = s.b JOIN lcs l2 ON l2.a = s.r1 AND l2.b = s.r2)
    SELECT posting_id, round(CASE WHEN length(a) + length(b) = 0 THEN 100.0 ELSE 200.0 * n1 / (length(a) + length(b)) END, 6) AS title_ratio,
      round(CASE WHEN c1 = '' AND c2 = '' THEN 100.0 WHEN c1 = '' OR c2 = '' THEN 0.0
        WHEN common <> '' AND (r1 = '' OR r2 = '') THEN 100.0
        ELSE GREATEST(100.0 - 100.0 * (length(r1) + length(r2) - 2 * n2) / (2 * base + length(r1) + length(r2)),
          CASE WHEN common <> '' THEN 100.0 - 100.0 * (1 + length(r1)) / (length(common) + base + length(r1)) ELSE 0 END,
          CASE WHEN common <> '' THEN 100.0 - 100.0 * (1 + length(r2)) / (length(common) + base + length(r2)) ELSE 0 END) END, 6) AS company_ratio
    FROM scored""",
)
def name_similarity(spark, sf_dir):
    """Ratios of every posting with the next one."""
    p = shapes.postings(spark, sf_dir).select(
        "posting_id", words.match_key(F.col("title")).alias("t"), words.match_key(F.col("company")).alias("c")
    )
    after = p.select((F.col("posting_id") - 1).alias("posting_id"), F.col("t").alias("t2"), F.col("c").alias("c2"))
    return p.join(after, "posting_id").select(
        "posting_id", F.round(similarity.sort_ratio(F.col("t"), F.col("t2")), 6).alias("title_ratio"),
        F.round(similarity.name_ratio(F.col("c"), F.col("c2")), 6).alias("company_ratio"),
    )


_LCS_RATIO = """
    steps(a, b, i, dp) AS (
      SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0) FROM todo
      UNION ALL
      SELECT a, b, i + 1, [0] || list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: GREATEST(dp[k + 1], CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN dp[k] + 1 ELSE 0 END))))
      FROM steps WHERE i < length(a)),
    lcs AS (SELECT a, b, dp[-1] AS n FROM steps WHERE i = length(a))"""


@query(
    "fuzzy_dedup",
    f"""WITH RECURSIVE {POSTINGS.strip()},
    keyed AS (SELECT posting_id, title, company, array_to_string(list_sort(string_split({_KEY.format(x='title')}, ' ')), ' ') AS t,
        array_to_string(list_sort(string_split({_KEY.format(x='company')}, ' ')), ' ') AS c FROM postings),
    nodes AS (SELECT t, c, min(posting_id) AS id FROM keyed GROUP BY ALL),
    ts AS (SELECT DISTINCT t FROM nodes), cs AS (SELECT DISTINCT c FROM nodes),
    cut AS (SELECT x.c AS c1, y.c AS c2, list_distinct(string_split(x.c, ' ')) AS p, list_distinct(string_split(y.c, ' ')) AS q FROM cs x, cs y),
    sets AS (SELECT c1, c2, array_to_string(list_sort(list_filter(p, lambda w: list_contains(q, w))), ' ') AS common,
        array_to_string(list_sort(list_filter(p, lambda w: NOT list_contains(q, w))), ' ') AS r1,
        array_to_string(list_sort(list_filter(q, lambda w: NOT list_contains(p, w))), ' ') AS r2 FROM cut),
    todo AS (SELECT x.t AS a, y.t AS b FROM ts x, ts y UNION SELECT r1, r2 FROM sets), {_LCS_RATIO.strip()},
    titles AS (SELECT x.t AS t1, y.t AS t2 FROM ts x, ts y JOIN lcs ON lcs.a = x.t AND lcs.b = y.t
      WHERE length(x.t) + length(y.t) = 0 OR 200.0 * n / (length(x.t) + length(y.t)) >= 82),
    measured AS (SELECT s.*, l.n, length(common) + CASE WHEN common <> '' THEN 1 ELSE 0 END AS base FROM sets s JOIN lcs l ON l.a = r1 AND l.b = r2),
    names AS (SELECT c1, c2 FROM measured WHERE CASE WHEN c1 = '' AND c2 = '' THEN 100.0 WHEN c1 = '' OR c2 = '' THEN 0.0
        WHEN common <> '' AND (r1 = '' OR r2 = '') THEN 100.0
        ELSE GREATEST(100.0 - 100.0 * (length(r1) + length(r2) - 2 * n) / (2 * base + length(r1) + length(r2)),
          CASE WHEN common <> '' THEN 100.0 - 100.0 * (1 + length(r1)) / (length(common) + base + length(r1)) ELSE 0 END,
          CASE WHEN common <> '' THEN 100.0 - 100.0 * (1 + length(r2)) / (length(common) + base + length(r2)) ELSE 0 END) END >= 88),
    before AS (SELECT late.id, list(early.id) AS ids FROM nodes late JOIN titles ON t1 = late.t JOIN names ON c1 = late.c
      JOIN nodes early ON early.t = t2 AND early.c = c2 AND early.id < late.id GROUP BY late.id),
    ordered AS (SELECT row_number() OVER (ORDER BY id) AS i, id, COALESCE(ids, []) AS ids FROM nodes LEFT JOIN before USING (id)),
    greedy(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
      SELECT o.i, CASE WHEN list_has_any(g.kept, o.ids) THEN g.kept ELSE list_append(g.kept, o.id) END FROM greedy g JOIN ordered o ON o.i = g.i + 1)
    SELECT posting_id, title, company FROM postings WHERE list_contains((SELECT arg_max(kept, i) FROM greedy), posting_id)""",
)
def fuzzy_dedup(spark, sf_dir):
    """Survivors over all postings."""
    return dedup.fuzzy(shapes.postings(spark, sf_dir)).select("posting_id", "title", "company")


@query("fuzzy_dedup_history", ORACLE["fuzzy_dedup"])
def fuzzy_dedup_history(spark, sf_dir):
    """Survivors of postings that come in batches, each against the index of what earlier ones kept; the same as over all postings."""
    rows = shapes.postings(spark, sf_dir).select("posting_id", "title", "company")
    index = kept.KeptIndex(spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}")
    most = rows.agg(F.max("posting_id")).first()[0] or 0
    out = None
    for number in range(BATCHES):
        part = index.keep(rows.where(F.floor(F.col("posting_id") * BATCHES / (most + 1)) == number), number)
        out = part if out is None else out.unionByName(part)
    return out


def named_parts(spark, sf_dir):
    """Postings with many spellings: part names and types by brand."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("posting_id"), F.concat_ws(" ", "p_name", F.lower("p_type"), pick(["engineer", "lead", "senior"], k)).alias("title"),
        F.concat_ws(" ", F.replace("p_brand", F.lit("#"), F.lit(" ")), pick(["inc", "labs", ""], k)).alias("company"),
        F.concat(F.lit("s"), (k % 4).cast("string")).alias("source"),
    )


@query("fuzzy_dedup_per_batch")
def fuzzy_dedup_per_batch(spark, sf_dir):
    """Survivors within each source, then over what is left."""
    first = dedup.fuzzy(named_parts(spark, sf_dir), ["source"])
    return dedup.fuzzy(first).select("posting_id", "title", "company", "source")


@query("expanded_queries")
def expanded_queries(spark, sf_dir):
    """Usable queries of the model answers, near copies removed per conversation."""
    a = answers(spark, sf_dir).withColumn("base", F.lit("aws sre"))
    rows = scorer.expand_queries(a, "base", "answer").withColumn("query_no", F.col("turn") * 10 + F.col("query_no"))
    return dedup.fuzzy_queries(rows, ["conv_id"]).select("conv_id", "query_no", "query")


@query("distinct_run_queries")
def distinct_run_queries(spark, sf_dir):
    return dedup.fuzzy_queries(run_queries(spark, sf_dir), ["run_id"]).select("run_id", "query_no", "query")


