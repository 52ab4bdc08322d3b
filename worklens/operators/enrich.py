"""Joins of postings with detail rows, page fields, crawl verdicts and the company dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages, urls
from ..functions.base import filled, strip, text, title_case
from ..functions.gates import is_alive
from .rank import first_n

PROFESSIONAL_KEYS = ["description", "apply_url", "workplace_type", "job_type", "applicants", "listed", "company_url"]
BOARD_KEYS = ["description", "job_type", "salary", "url"]
PAGE_KEYS = ["title", "company", "location", "salary", "experience", "keyskills", "listed", "apply_url"]


def _merged(df: DataFrame, keys: list[str], prefix: str, hit: Column, failure: str) -> DataFrame:
    """Non-empty detail values win; the quality becomes full; a missing detail is recorded."""
    asked = F.col("_asked")
    out = {k: F.when(hit, F.coalesce(filled(F.col(prefix + k)), F.col(k))).otherwise(F.col(k)) for k in keys}
    out["data_quality"] = F.when(hit, "full").otherwise(F.col("data_quality"))
    out["enrich_source"] = F.when(hit, "detail")
    out["enrich_error"] = F.when(asked & ~hit, failure)
    return df.withColumns(out)


def latest(rows: DataFrame, key: str | Column, fields: list[str], landed: str = "landed_at") -> DataFrame:
    """(key, fields) of the newest row of each key by ``landed`` (where the table has it; then by the fields)."""
    order = [landed] if landed in rows.columns else []
    named = key if isinstance(key, Column) else F.col(key)
    best = rows.groupBy(named.alias("_key")).agg(F.max(F.struct(*order, *[f for f in fields if f not in order])).alias("_best"))
    return best.select("_key", *[F.col(f"_best.{f}").alias(f) for f in fields])


def _keyed(postings: DataFrame, asked: Column, key: Column) -> DataFrame:
    """Add ``_asked`` and ``_key``. Rows that ask for nothing get keys that meet nothing and spread over all tasks."""
    plain = [c for c, kind in postings.dtypes if kind in ("string", "bigint", "int")]
    nowhere = F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string"))
    df = postings.withColumn("_asked", F.coalesce(asked, F.lit(False)))
    return df.withColumn("_key", F.when(F.col("_asked"), F.coalesce(key, nowhere)).otherwise(nowhere))


def _joined(df: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    found = details.select("_key", F.lit(True).alias("_hit"), *[F.col(k).alias("d_" + k) for k in keys])
    return df.join(found, "_key", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _bare(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.drop("_key", "_hit", "_asked", *["d_" + k for k in keys])


def professional_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    """The newest details by canonical url for the network postings; salary is never taken."""
    asked = (F.col("source") == "LinkedIn") & F.contains(F.col("url"), F.lit("linkedin.com/jobs"))
    # Several landed urls may share one canonical form: one detail row per key.
    newest = latest(details, urls.canonical_job_url(F.col("url")), PROFESSIONAL_KEYS)
    df = _joined(_keyed(postings, asked, F.when(asked, urls.canonical_job_url(F.col("url")))), newest, PROFESSIONAL_KEYS)
    df = _merged(df, PROFESSIONAL_KEYS, "d_", F.col("_hit"), "job-detail failed")
    stable = urls.stable_apply_url(F.col("url"), F.col("apply_url"))
    return _bare(df.withColumn("apply_url", F.when(F.col("_hit") & (F.col("apply_url") != ""), stable).otherwise(F.col("apply_url"))), PROFESSIONAL_KEYS)


def board_details(postings: DataFrame, details: DataFrame) -> DataFrame:
    """The newest details by job key for the board postings, salary included."""
    asked = (F.col("source") == "Indeed") & (text(F.col("job_key")) != "")
    df = _joined(_keyed(postings, asked, F.col("job_key")), latest(details, "job_key", BOARD_KEYS), BOARD_KEYS)
    return _bare(_merged(df, BOARD_KEYS, "d_", F.col("_hit"), "job detail failed"), BOARD_KEYS)


def rendered_fallback(ranked: DataFrame, rendered: DataFrame, n: int | None = None) -> DataFrame:
    """Rendered page text for the network postings; ``n`` limits it to the first ranks (``ranked`` has ``rank``)."""
    asked = (F.col("source") == "LinkedIn") & F.contains(F.col("url"), F.lit("linkedin.com/jobs"))
    asked = asked if n is None else asked & (F.col("rank") <= n)
    written = rendered.withColumn("page", strip(text(F.col("page")))).filter(F.col("page") != "")
    newest = latest(written, urls.canonical_job_url(F.col("url")), ["page"])
    df = _joined(_keyed(ranked, asked, F.when(asked, urls.canonical_job_url(F.col("url")))), newest, ["page"])
    hit = F.col("_hit")
    df = df.withColumns(
        {
            "description": F.when(hit, F.col("d_page")).otherwise(F.col("description")),
            "data_quality": F.when(hit, "partial").otherwise(F.col("data_quality")),
            "enrich_source": F.when(hit, "rendered"),
        }
    )
    return _bare(df, ["page"])


def page_fields(postings: DataFrame, fields: DataFrame, by: list[str], order: str = "posting_id", most: int | None = None) -> DataFrame:
    """Merge the newest parsed page fields into the portal postings, or the first ``most`` of each batch.

    ``fields`` holds url, expired, and a ``page`` struct (NULL when the parse
    failed). Page values win, a title only when usable; expired rows go.
    """
    portal = urls.is_portal_posting(F.col("url"))
    if most is None:
        df = postings.withColumn("_target", F.coalesce(portal, F.lit(False)))
    else:
        first = first_n(postings.filter(portal).select(*by, order), most, by, [F.asc(order)]).select(*by, order, F.lit(True).alias("_target"))
        df = postings.join(first, [*by, order], "left").withColumn("_target", F.coalesce("_target", F.lit(False)))
    newest = latest(fields.filter(F.col("url").isNotNull()), "url", ["expired", "page"])
    df = _joined(_keyed(df, F.col("_target"), F.col("url")), newest, ["expired", "page"])
    df = df.filter(~(F.col("_target") & F.coalesce("d_expired", F.lit(False))))
    target, hit = F.col("_target"), F.col("d_page").isNotNull()
    body = filled(F.col("d_page.description"))
    out = {
        "data_quality": F.when(~hit, "snippet").when(body.isNotNull(), "full").otherwise("partial"), "enrich_source": F.when(hit, "job-page"),
        "backend": F.when(hit, "job-page").otherwise(F.col("backend")), "enrich_error": F.when(~hit, "job page fetch/parse failed"),
        "description": F.coalesce(body, F.col("description")),
    }
    for k in PAGE_KEYS:
        value = filled(F.col(f"d_page.{k}"))
        value = F.when(pages.is_usable_title(value), value) if k == "title" else value
        out[k] = F.coalesce(value, F.col(k)) if k in postings.columns else value
    kept = lambda k: F.col(k) if k in postings.columns else F.lit(None)
    df = df.withColumns({k: F.when(target, v).otherwise(kept(k)) for k, v in out.items()})
    return _bare(df, ["expired", "page"]).drop("_target")


def batch_quality(postings: DataFrame, by: list[str]) -> DataFrame:
    """Best quality per batch (full over partial over snippet) and its number of page-enriched rows."""
    code = F.array_position(F.array(F.lit("snippet"), F.lit("partial"), F.lit("full")), F.col("data_quality"))
    return postings.groupBy(*by).agg(
        F.element_at(F.array(F.lit("snippet"), F.lit("partial"), F.lit("full")), F.greatest(F.max(code), F.lit(1)).cast("int"))
        .alias("data_quality"),
        F.count_if(F.col("enrich_source") == "job-page").alias("n_enriched"),
    )


def live_only(postings: DataFrame, crawl: DataFrame) -> DataFrame:
    """Drop postings whose newest crawl result shows them dead; a url without a result counts as alive."""
    newest = latest(crawl, "url", ["status", "final_url", "body"])
    dead = newest.filter(~is_alive(F.col("_key"), F.col("status"), F.col("final_url"), F.col("body"))).select(F.col("_key").alias("url"))
    return postings.join(dead, "url", "left_anti")


def company_by_domain(hosts: DataFrame, companies: DataFrame, url: str = "url") -> DataFrame:
    """Add ``company``: the first listed company whose domain is a dot-suffix of the host, or the reverse.

    ``companies`` holds ord, company, domain. Suffixes are exploded on both
    sides, which turns the suffix test into two equi-joins over distinct hosts.
    """
    host = urls.plain_domain(urls.host(F.col(url)))
    keyed = hosts.withColumn("_host", host)
    names = keyed.select("_host").distinct()
    dims = companies.select("ord", "company", urls.plain_domain(F.col("domain")).alias("_domain"))
    by_host = names.select("_host", F.explode(urls.suffixes(F.col("_host"))).alias("_domain")).join(dims, "_domain")
    by_domain = dims.select("ord", "company", F.explode(urls.suffixes(F.col("_domain"))).alias("_host")).join(
        names, "_host", "left_semi"
    )
    best = by_host.select("_host", "ord", "company").unionByName(by_domain.select("_host", "ord", "company"))
    best = best.groupBy("_host").agg(F.min_by("company", "ord").alias("_company"))
    label = title_case(F.get(F.split("_host", r"\."), F.lit(0)))
    return keyed.join(best, "_host", "left").withColumn(
        "company", F.coalesce("_company", label)
    ).drop("_host", "_company")
