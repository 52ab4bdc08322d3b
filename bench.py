"""Headline queries on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from worklens.catalog import load  # noqa: E402
from worklens.session import local_session, ship  # noqa: E402

HEADLINE = [
    "normalized_postings", "filter_report", "top_postings", "full_ranking", "fuzzy_dedup", "fuzzy_dedup_per_batch",
    "seen_upsert", "new_or_seen", "saved_upsert", "breaker_state", "keyword_hits",
    "company_by_domain", "posting_page_fields", "city_in_free_text", "seen_stream", "best_for_many_profiles",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    queries = load().QUERIES
    names = sys.argv[1:] or HEADLINE
    # One unmeasured run starts the JVM's compilers and the Python workers.
    queries["name_similarity"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
             "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
