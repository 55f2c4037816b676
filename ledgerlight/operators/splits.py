"""Row ranges handled apart and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators import aggregates


def sided(df: DataFrame, fraction: float, batch: int) -> DataFrame:
    """Adds tail: whether a row is in the tail of its file, which has about the given fraction of the file's rows, whatever
    is filtered later; the cut is aligned down to a batch. Row counts come from positions alone, a scan without columns, and
    go out as a broadcast of one row a file: a hundred bytes to each file of the table."""
    counts = df.groupBy("row_file").agg((F.max("row_pos") + 1).alias("n"))
    cut = (F.floor((F.col("n") * (1 - fraction)) / batch) * batch).alias("cut")
    return df.join(F.broadcast(counts.select("row_file", cut)), "row_file").withColumn("tail", F.col("row_pos") >= F.col("cut")).drop("cut")


def split_at_fraction(df: DataFrame, fraction: float, batch: int) -> list[DataFrame]:
    """Head and tail of each file's rows."""
    both = sided(df, fraction, batch)
    return [both.filter(~F.col("tail")).drop("tail"), both.filter("tail").drop("tail")]


def merged(both: DataFrame, keys: list[str], terms: dict[str, tuple[Column, int]]) -> DataFrame:
    """Partial states of head and tail, from one scan, added group by group."""
    return aggregates.summed(both, ["tail", *keys], terms).groupBy(*keys).agg(*aggregates.merged_sums())
