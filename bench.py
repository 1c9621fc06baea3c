"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "seo_score", "geo_score_v2", "content_shape", "page_links", "findings", "field_completeness", "site_issues", "inlink_counts",
    "click_depth", "connected_components", "shingles", "duplicate_groups", "query_overlap", "query_clusters", "hreflang_issues",
    "crawler_policies", "robots_admission", "period_diff", "vital_overall", "serp_dedup", "rank_summary", "query_competitors",
    "topic_gap", "answer_status", "citation_diff", "materialize_run", "version_chain", "diff_observations", "gap_verdict",
    "verify_opportunities",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from siteglass.plans.catalog import registered
    from siteglass.session import local_session

    spark = local_session(cpus, "siteglass-bench")
    queries, _ = registered()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
