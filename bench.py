"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "long_to_wide",
    "pass_rates",
    "wafer_robust_stats",
    "product_wafer_baseline",
    "population_robust_stats",
    "ranked_findings",
    "median_percentile",
    "wafer_sequences",
    "pattern_rules",
    "shot_overlap_items",
    "per_test_aggregates",
    "item_metrics",
    "margin_window",
    "daily_band",
    "item_context",
    "chained_rule_trace",
    "digest_recurring_sites",
]


def main() -> None:
    from checks.catalog import QUERIES
    from waferlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    QUERIES["recent_days_scan"](spark, sf_dir).count()  # start-up is not measured
    seconds = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
