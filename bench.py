"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line: seconds per query, best of 3 after a warm run."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "revenue_by_customer", "best_sellers", "budget_by_segment", "pricing_summary", "semi_anti", "page_sorted", "column_profile", "top_values", "pivot_summary", "quick_chart",
    "log_lines", "canonical_names", "match_token_set", "match_grouped", "geo_sql", "quality_report", "cosine_topk", "shortest_paths", "json_props",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from loomgrid.plans import registry
    from loomgrid.session import build_session

    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for k in range(runs + 1):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            if k:
                best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
