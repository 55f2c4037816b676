"""Times the headline queries; prints one JSON line. Reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from ledgerlight.plans.catalog import QUERIES
from ledgerlight.session import build_session
from ledgerlight.sources.sinks import discard

HEADLINE = ("q1_pricing_summary", "q1_compressed", "q1_wide_decimal", "q1_conditional_rows", "q1_overflow_checked", "q1_morsel_partials", "q1_range_split_merge", "q1_filter_bitmap_agg", "q1_selectivity", "q1_column_stats")
RUNS = 5


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus)
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            discard(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "q1_pricing_summary_seconds", "value": took["q1_pricing_summary"], "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
