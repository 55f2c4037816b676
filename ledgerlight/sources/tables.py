"""Parquet tables, row positions and prefix restriction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.schema import Q1_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str, *, position: bool = False) -> DataFrame:
    """The seven pricing columns; position adds row_file and row_pos, the row's place in its file."""
    df = table(spark, sf_dir, "lineitem")
    if position:
        df = df.select(*Q1_COLUMNS, F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_pos"))
    else:
        df = df.select(*Q1_COLUMNS)
    return df


#: Fixed value: rows of a whole table at scale factor 1.
WHOLE_ROWS = 6001215


def prefix(df: DataFrame, scale: float, whole: int = WHOLE_ROWS) -> DataFrame:
    """If df has exactly whole rows, scale (up to 1) of them, the first by file and stored position; else all. Unlike
    limit(n), the same rows every time. Positions restart in each file, so counts of files, a row each, tell where a file
    begins."""
    counts = df.groupBy("row_file").agg((F.max("row_pos") + 1).alias("n"))
    ahead = Window.orderBy("row_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    begins = counts.select("row_file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    kept = df.join(F.broadcast(begins), "row_file").filter((F.col("rows") != whole) | (F.col("begin") + F.col("row_pos") < F.floor(F.lit(whole) * F.lit(scale))))
    return kept.drop("begin", "rows")
