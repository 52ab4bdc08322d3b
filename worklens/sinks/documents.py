"""Result documents of a search or watch run.

A document is a header row and one JSON line per ranked posting, so a run of
any size is written in parallel. ``document`` nests the first n lines into one
JSON text for a run whose page fits a single reply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import tenths


def totals(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Found, enriched and verdict counts from three boolean columns."""
    return rows.groupBy(*(by or [])).agg(
        F.count_if("found").alias("found_count"), F.count_if("enriched").alias("enriched_count"),
        F.count_if("verdict").alias("verdict_count"),
    )


def job_lines(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """Rank and JSON of each posting, with ``match_score`` to one decimal and the reasons."""
    job = F.struct(*columns, tenths(F.col("score")).alias("match_score"), F.col("reasons"))
    keys = [c for c in ("run_id", "profile_id") if c in ranked.columns]
    return ranked.select(*keys, "rank", F.to_json(job).alias("job"))


def header(run: DataFrame, command: str = "search") -> DataFrame:
    """Header fields as one row per run; text and list fields default to empty."""
    fields = {
        "generated_at": "string", "query": "string", "location": "string", "days": "int", "ai_used": "boolean",
        "ai_budget_used": "bigint", "filter_summary": "string", "filter_note": "string", "found_count": "bigint",
        "enriched_count": "bigint", "verdict_count": "bigint", "source_counts": "map<string,bigint>",
        "source_errors": "map<string,array<string>>", "filter_notes": "array<string>",
    }
    out = [F.lit(command).alias("command")]
    for name, kind in fields.items():
        c = F.col(name).cast(kind) if name in run.columns else F.lit(None).cast(kind)
        blank = {"string": F.lit(""), "boolean": F.lit(False), "bigint": F.lit(0), "array<string>": F.array().cast("array<string>")}.get(kind)
        blank = F.from_json(F.lit("{}"), kind) if kind.startswith("map") else blank
        out.append((c if blank is None else F.coalesce(c, blank)).alias(name))
    extra = [c for c in run.columns if c not in fields]
    return run.select(*extra, *out)


def with_sources(run: DataFrame, counts: DataFrame, errors: DataFrame) -> DataFrame:
    """Add source_counts and source_errors to runs from (run_id, source, n_rows) and (run_id, source, error); sources of a run are few."""
    n = counts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n_rows")))).alias("source_counts"))
    listed = errors.groupBy("run_id", "source").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    bad = listed.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "errors")))).alias("source_errors"))
    return run.join(n, "run_id", "left").join(bad, "run_id", "left")


def new_jobs(flagged: DataFrame, columns: list[str]) -> DataFrame:
    """The new postings of a watch run as ranked JSON lines; a document nests them as its jobs."""
    return job_lines(flagged.filter(~F.col("is_seen")), columns)


def watch_header(run: DataFrame, flagged: DataFrame, seen_after: DataFrame) -> DataFrame:
    """Header of a watch run: new and seen rows of the run, size of the seen table, urls marked."""
    counts = flagged.agg(F.count_if(~F.col("is_seen")).alias("new_count"), F.count_if("is_seen").alias("seen_count"))
    marks = seen_after.agg(
        F.count(F.lit(1)).alias("seen_urls_total"), F.count_if("is_new").alias("marked_seen")
    )
    # Three one-row tables; the constant key makes this an equi-join.
    one = F.lit(1).alias("_one")
    joined = header(run, "watch").select("*", one).join(counts.select("*", one), "_one")
    return joined.join(marks.select("*", one), "_one").drop("_one")


def document(head: DataFrame, lines: DataFrame, n: int, key: str = "run_id") -> DataFrame:
    """One JSON text per run with its header and first n postings."""
    jobs = lines.filter(F.col("rank") <= n).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "job"))).alias("_jobs")
    )
    body = F.to_json(F.struct(*[c for c in head.columns if c != key]))
    listed = F.array_join(F.transform(F.coalesce("_jobs", F.array()), lambda x: x["job"]), ",")
    text = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(',"jobs":['), listed, F.lit("]}"))
    return head.join(jobs, key, "left").select(key, text.alias("document"))


def parts(head: DataFrame, lines: DataFrame) -> DataFrame:
    """Header and lines as one table (run_id, rank, body), the header with rank 0: what the committed sink publishes together."""
    top = head.select("run_id", F.lit(0).cast("long").alias("rank"), F.to_json(F.struct(*[c for c in head.columns if c != "run_id"])).alias("body"))
    return top.unionByName(lines.select("run_id", F.col("rank").cast("long").alias("rank"), F.col("job").alias("body")))
