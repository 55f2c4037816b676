"""Command line: `python -m ledgerlight.cli --scale-factor=0.1 --runs=5 --print-results`."""

from __future__ import annotations

import argparse
import time

from ledgerlight.config import PLACEMENTS, RunOptions
from ledgerlight.plans.pricing import planned
from ledgerlight.session import build_session
from ledgerlight.sources import sinks


def parse(argv: list[str] | None = None) -> tuple[RunOptions, int]:
    d = RunOptions()
    p = argparse.ArgumentParser(description="Run the pricing summary and report seconds for each run.")
    p.add_argument("--data-dir", default=d.data_dir)
    p.add_argument("--scale-factor", type=float, default=d.scale_factor)
    p.add_argument("--runs", type=int, default=d.runs)
    p.add_argument("--plan", "--hash-table-placement", dest="plan", choices=PLACEMENTS, default=d.plan)
    p.add_argument("--apply-compression", action="store_true")
    p.add_argument("--use-filter-pushdown", action="store_true")
    p.add_argument("--use-coprocessing", action="store_true")
    p.add_argument("--cpu-fraction", type=float, default=d.cpu_fraction)
    p.add_argument("--rows-per-launch", "--tuples-per-kernel-launch", dest="rows_per_launch", type=int, default=d.rows_per_launch)
    p.add_argument("--print-results", action="store_true")
    p.add_argument("--results-csv")
    p.add_argument("--cpus", type=int, default=8)
    a = vars(p.parse_args(argv))
    cpus = a.pop("cpus")
    try:
        return RunOptions(**a), cpus
    except ValueError as e:
        p.error(str(e))


def main(argv: list[str] | None = None) -> int:
    options, cpus = parse(argv)
    spark = build_session(f"local[{cpus}]", cpus)
    seconds = []
    for _ in range(options.runs):
        began = time.perf_counter()
        lines = sinks.result_lines(planned(spark, options))
        seconds.append(time.perf_counter() - began)
    if options.print_results:
        print("\n".join(f"# {x}" for x in lines))
    if options.results_csv:
        sinks.write_timings(options.results_csv, seconds)
    print(" ".join(f"{s:.3f}" for s in seconds))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
