"""Search hits as postings: cheap gates first, then the cleaned fields, then dedup by url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, gates, times, urls
from ..functions.base import filled, first_filled, replace, split, strip, text
from ..operators import dedup, enrich


def _stop_after(df: DataFrame, by: list[str], enough: int | None) -> DataFrame:
    """Keep the site queries up to the one that brings a run to ``enough`` rows; all by default.

    Rows are counted per site query first; the running sum is over a run's few
    site queries, never over its rows.
    """
    if enough is None:
        return df
    counts = df.groupBy(*by, "site_no").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("site_no").rowsBetween(Window.unboundedPreceding, -1)
    open_ = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < enough)
    return df.join(open_.select(*by, "site_no"), [*by, "site_no"], "left_semi")


def _gated(hits: DataFrame, query: Column, location: Column, days: int | None, as_of: Column) -> DataFrame:
    t, u, b = F.col("title"), F.col("href"), F.col("body")
    df = hits.filter(
        (text(t) != "") & (text(u) != "") & ~gates.is_homepage(u) & ~gates.is_search_page(t, u)
        & ~gates.is_non_posting_url(u) & ~gates.is_non_posting_title(t) & gates.is_relevant(t, query, location)
    )
    return df.filter(~times.snippet_older_than(b, days, as_of)) if days else df


def web_keyword(
    hits: DataFrame, query: Column, location: Column, days: int | None, as_of: Column, by: list[str],
    enough: int | None = None, order: str = "hit_id",
) -> DataFrame:
    """Keyword hits: by (the run), site_no, order, title, href, body."""
    df = _gated(hits, query, location, days, as_of)
    everything = F.concat_ws(" ", F.col("title"), F.col("href"), F.col("body"))
    df = df.select(
        *by, "site_no", order, extract.clean_web_title(F.col("title")).alias("title"),
        extract.company_from_text(F.col("href"), F.col("body"), F.col("title")).alias("company"),
        extract.location_from_text(everything, F.col("body")).alias("location"),
        F.col("body").alias("description"), F.col("href").alias("url"), F.lit("Web Search").alias("source"),
        F.lit("ddgs").alias("backend"), F.lit("snippet").alias("data_quality"),
    )
    df = df.filter((F.col("title") != "") & ~gates.is_search_page(F.col("title"), F.col("url")))
    df = _stop_after(df, by, enough)
    return dedup.first_by(df, [*[F.col(c) for c in by], F.col("url")], order)


def career_boards(
    hits: DataFrame, companies: DataFrame, query: Column, location: Column, days: int | None, as_of: Column,
    by: list[str], enough: int | None = None, order: str = "hit_id",
) -> DataFrame:
    """Career-board hits; the company comes from the domain dimension (ord, company, domain)."""
    df = _gated(hits, query, location, days, as_of)
    everything = F.concat_ws(" ", F.col("title"), F.col("body"))
    df = df.select(
        *by, "site_no", order, extract.clean_board_title(F.col("title")).alias("title"),
        extract.location_from_text(everything, F.col("body")).alias("location"),
        F.col("body").alias("description"), F.col("href").alias("url"), F.lit("Career Sites").alias("source"),
        F.lit("ddgs").alias("backend"), F.lit("snippet").alias("data_quality"),
    )
    df = df.filter((F.col("title") != "") & ~gates.is_search_page(F.col("title"), F.col("url")))
    df = _stop_after(df, by, enough)
    return enrich.company_by_domain(dedup.first_by(df, [*[F.col(c) for c in by], F.col("url")], order), companies)


def web_semantic(
    hits: DataFrame, crawl: DataFrame, query: Column, location: Column, days: int | None, as_of: Column,
    by: list[str], order: str = "hit_id",
) -> DataFrame:
    """Semantic hits (title, url, text, publishedDate, author, score): gates and dedup, then the crawl verdict."""
    df = hits.withColumn("title", extract.clean_web_title(F.col("title")))
    df = df.filter(
        (F.col("title") != "") & (text(F.col("url")) != "") & ~gates.is_homepage(F.col("url"))
        & gates.is_relevant(F.col("title"), query, location) & ~gates.is_non_posting_title(F.col("title"))
    )
    if days:
        df = df.filter(~times.iso_older_than(F.col("publishedDate"), days, as_of))
    df = dedup.first_by(df, [*[F.col(c) for c in by], F.col("url")], order)
    df = enrich.live_only(df, crawl)
    u, s, t = F.col("url"), text(F.col("text")), F.col("title")
    return df.select(
        *by, order, "title",
        F.coalesce(filled(urls.company_from_host(u)), filled(strip(text(F.col("author")))), extract.company_from_text(u, s, t)).alias("company"),
        extract.location_from_text(F.concat_ws(" ", t, u, s), s).alias("location"), s.alias("description"),
        "url", F.lit("Web Search").alias("source"), F.substring(text(F.col("publishedDate")), 1, 10).alias("listed"),
        F.col("score").cast("double").alias("score"), F.lit("exa").alias("backend"), F.lit("partial").alias("data_quality"),
    )


def portal(hits: DataFrame, asked_location: Column, by: list[str], order: str = "hit_id") -> DataFrame:
    """Portal hits: real posting urls only, aggregates and navigation titles dropped, first per url."""
    t, u, b = F.col("title"), F.col("href"), text(F.col("body"))
    df = hits.filter(
        (text(t) != "") & F.contains(F.lower(text(u)), F.lit("naukri.com")) & ~gates.is_portal_aggregate(u)
        & urls.is_portal_posting(u) & ~gates.is_non_posting_title(t)
    )
    df = dedup.first_by(df, [*[F.col(c) for c in by], u], order)
    cleaned = extract.clean_portal_title(t)
    spoken = F.when(
        (cleaned == "") | F.startswith(cleaned, F.lit("naukri")), first_filled(extract.title_from_slug(u), cleaned, t)
    ).otherwise(cleaned)
    df = df.withColumn("_title", spoken)
    return df.select(
        *by, order, first_filled(F.col("_title"), t).alias("title"),
        extract.portal_company(u, b, t, F.col("_title")).alias("company"), extract.portal_location(b, asked_location).alias("location"),
        b.alias("description"), u.alias("url"), F.lit("Naukri").alias("source"),
        F.lit("ddgs").alias("backend"), F.lit("snippet").alias("data_quality"),
    )


def site_restricted(hits: DataFrame, asked_location: Column, by: list[str], order: str = "hit_id") -> DataFrame:
    """Board hits found by a site search: title, company and place out of the dashed title. Not deduplicated."""
    b = text(F.col("body"))
    df = hits.filter((text(F.col("title")) != "") & (text(F.col("href")) != ""))
    bare = strip(replace(F.col("title"), r"\s*[-–|]\s*Indeed(\.com)?\s*$"))
    df = df.withColumn("_parts", F.transform(split(bare, r"\s+[-–|]\s+", False), lambda x: strip(x)))
    parts, n = F.col("_parts"), F.size("_parts")
    place = F.when(n >= 3, F.array_join(F.slice(parts, F.lit(3), F.greatest(n, F.lit(1))), " - ")).when(n == 2, F.get(parts, F.lit(1)))
    return df.select(
        *by, order, F.get(parts, F.lit(0)).alias("title"), extract.site_company(b, parts).alias("company"),
        first_filled(place, asked_location, F.lit("India")).alias("location"), b.alias("description"),
        F.col("href").alias("url"), F.lit("Indeed").alias("source"), F.lit("ddgs").alias("backend"), F.lit("snippet").alias("data_quality"),
    )
