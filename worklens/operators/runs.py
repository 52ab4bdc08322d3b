"""Source runs: counts, errors, circuit breaker, health, arrival budget, backend choice, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import small


def rows_per_source(batches: DataFrame) -> DataFrame:
    return batches.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


def errors_per_source(runs: DataFrame) -> DataFrame:
    """Distinct error messages per source with their number: rows, since the list has no bound."""
    flat = runs.select("source", F.explode("errors").alias("error"))
    return flat.groupBy("source", "error").agg(F.count(F.lit(1)).alias("n"))


def breaker_state(runs: DataFrame, as_of: Column) -> DataFrame:
    """Per source: streaks, last success, end of the cooldown, open or not.

    A streak is the number of runs after the last run of the other kind, so
    two aggregations replace a window over all runs of a source, and a source
    with most of the runs is no hot spot. ``runs`` holds source, ts, run_id, ok.
    """
    at = F.struct(F.col("ts"), F.col("run_id"))
    last = runs.groupBy("source").agg(
        F.max(F.when(F.col("ok"), at)).alias("_ok"), F.max(F.when(~F.col("ok"), at)).alias("_bad")
    )
    later = lambda edge: F.col(edge).isNull() | (at > F.col(edge))
    joined = runs.join(small(last), "source")
    out = joined.groupBy("source").agg(
        F.count_if(F.col("ok") & later("_bad")).alias("ok_streak"),
        F.count_if(~F.col("ok") & later("_ok")).alias("fail_streak"),
        F.max("_ok.ts").alias("last_ok"),
        F.max("_bad.ts").alias("last_bad"),
    )
    until = F.when(
        F.col("fail_streak") >= fixed.BREAKER_FAILURES, F.col("last_bad") + fixed.BREAKER_COOLDOWN
    ).otherwise(0.0)
    out = out.withColumn("cooldown_until", until.cast("double"))
    return out.select(
        "source", "ok_streak", "fail_streak", F.coalesce("last_ok", F.lit(0.0)).alias("last_ok"),
        "cooldown_until", (F.col("cooldown_until") > as_of.cast("double")).alias("is_open"),
    )


def health(runs: DataFrame, as_of: Column) -> DataFrame:
    """Status per source: error while the circuit is open, warn after a failed last run, else ok."""
    state = breaker_state(runs, as_of)
    counts = runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(~F.col("ok")).alias("n_failed")
    )
    status = F.when(F.col("is_open"), "error").when(F.col("fail_streak") > 0, "warn").otherwise("ok")
    note = F.when(F.col("is_open"), "circuit OPEN (cooldown until skip)").otherwise("")
    return state.join(counts, "source").withColumns({"status": status, "message": note})


def skip_open(plan: DataFrame, state: DataFrame) -> DataFrame:
    """Plan rows whose source is not inside its cooldown."""
    return plan.join(state.filter("is_open").select("source"), "source", "left_anti")


def within_budget(batches: DataFrame, budget: int = 120) -> DataFrame:
    """Batches that arrived before their run's wall budget ran out."""
    return batches.filter(F.col("arrived_at") <= F.col("started_at") + budget)


def ordered_backends(preference: list[str], override: str | None = None) -> list[str]:
    """Preference order with the named backend moved to the front; an unknown name changes nothing."""
    front = [b for b in preference if override and (b == override or b.startswith(override))][:1]
    return front + [b for b in preference if b not in front]


def first_backend(batches: DataFrame, preference: list[str], override: str | None = None) -> DataFrame:
    """Batches of the first usable backend per (source, query)."""
    order = ordered_backends(preference, override)
    place = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("backend"))
    usable = batches.filter(F.col("could_run") & (place > 0)).withColumn("_place", place)
    best = usable.groupBy("source", "query").agg(F.min("_place").alias("_place"))
    return usable.join(best, ["source", "query", "_place"], "left_semi").drop("_place")


def query_plan(queries: DataFrame, sources: list[str], caps: dict[str, int] | None = None) -> DataFrame:
    """(query, source) tasks: every source runs all queries of a run, or its first ones by ``caps`` (such as ``fixed.QUERY_CAPS``).

    ``queries`` holds run_id, query_no (from 1), query. Sources are a handful of
    constants, so they are exploded in place and nothing is joined.
    """
    limits = caps or {}
    tasks = F.array(
        *[F.struct(F.lit(s).alias("source"), F.lit(limits.get(s, 2**31 - 1)).alias("cap")) for s in sources]
    )
    out = queries.select("*", F.inline(tasks)).filter(F.col("query_no") <= F.col("cap"))
    # Only the first query of a run pays for recovering missing titles.
    return out.withColumn("recover_titles", (F.col("source") == "Indeed") & (F.col("query_no") == 1)).drop("cap")


def web_site_queries(queries: DataFrame) -> DataFrame:
    """Four posting hosts, then one open query, per query and location."""
    base = F.concat_ws(" ", F.col("query"), F.col("location"))
    sites = [F.concat(F.lit(f"site:{h} "), base) for h in fixed.POSTING_HOSTS] + [F.concat(base, F.lit(" career"))]
    return queries.select("*", F.posexplode(F.array(*sites)).alias("site_no", "site_query"))


def board_site_queries(queries: DataFrame, domains: DataFrame, most: int | None = None) -> DataFrame:
    """Five board hosts, then the career domains in order, ``most`` in all (by default every one) per query.

    Each query is asked of each host, so the hosts travel in shares: a share of them meets every query by its number.
    """
    career = domains.select("domain").distinct()
    career = career if most is None else career.orderBy("domain").limit(max(0, most - len(fixed.BOARD_HOSTS)))
    boards = fixed.BOARD_HOSTS if most is None else fixed.BOARD_HOSTS[:most]
    shares = 16
    hosts = career.select(F.col("domain").alias("host"), F.pmod(F.xxhash64("domain"), F.lit(shares)).cast("int").alias("_share"))
    base = F.concat_ws(" ", F.col("query"), F.col("location"))
    asked = queries.withColumn("_base", base)
    fixed_part = asked.withColumn("host", F.explode(F.array(*[F.lit(h) for h in boards]).cast("array<string>")))
    spread = asked.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).join(hosts, "_share").drop("_share")
    both = fixed_part.unionByName(spread)
    return both.withColumn("site_query", F.concat(F.lit("site:"), "host", F.lit(" "), "_base")).drop("_base", "host")
