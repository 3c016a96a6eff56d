"""Time the headline queries: one warm-up, then the median of three runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from hostledger.session import build_session, drop_scratch
from verification import queries as registered

HEADLINE = [
    "preprocess_urls",
    "preprocess_stats",
    "extract_links",
    "discovered_urls",
    "root_target",
    "crawl_frontier",
    "url_diff",
    "diff_counts_by_session",
    "url_inventory",
    "facets",
    "dashboard_stats",
    "search_report",
    "error_digest",
    "content_changes",
    "line_diff_counts",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered.queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            drop_scratch(spark)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
