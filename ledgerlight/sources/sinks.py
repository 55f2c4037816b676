"""Result, selectivity and timing sinks."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame


def result_lines(summary: DataFrame) -> list[str]:
    """One `rf|ls|...` line per group. A pricing summary has one row per flag pair, so collecting is bounded."""
    rows = summary.orderBy("l_returnflag", "l_linestatus").collect()
    return ["|".join(str(v) for v in r) for r in rows]


def write_timings(path: str, seconds: Sequence[float]) -> None:
    """One seconds value per run, on the driver's own disk: a bench log, not data."""
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([[f"{s:.6f}"] for s in seconds])


def discard(df: DataFrame) -> None:
    """Run a plan to its end without keeping rows: projection-only timing."""
    df.write.format("noop").mode("overwrite").save()
