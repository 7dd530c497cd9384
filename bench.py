"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. Results are
written to the no-op sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stopclock.plans.catalog import queries
from stopclock.session import build_session

HEADLINE = [
    "stop_daily",
    "stop_hourly",
    "history_stats_all",
    "history_stats_am_peak",
    "history_hourly",
    "area_reliability",
    "sample_pairs",
    "stop_arrivals",
    "derived_stop_daily",
    "segment_speeds",
    "segment_weekly_merge",
    "segment_weekly_last_day",
    "bucketed_quantiles",
    "network_patterns",
    "network_vertices",
    "subscription_state",
    "cancellation_policy",
    "visible_rows",
    "merge_records",
    "replace_groups",
    "permit_decisions",
    "permit_details",
    "rate_limit_audit",
    "quota_status",
    "diversity_index",
    "relief_summary",
    "derive_job_daily",
    "history_sql",
    "stream_sample_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            # One small file per table here: cut scans so that every core has work.
            "spark.sql.files.maxPartitionBytes": str(1 << 20),
            "spark.sql.files.openCostInBytes": str(64 << 10),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    timings: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total median query time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
