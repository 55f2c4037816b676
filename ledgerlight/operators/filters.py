"""Row filters and the filter bitmap."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import dates, encodings


def shipped_by(day: date | None = None) -> Column:
    """Inclusive; null dates fail. The DATE literal is pushed to the Parquet scan."""
    return F.col("l_shipdate") <= F.lit(day or dates.cutoff())


def by_day_offset(df: DataFrame, day: date | None = None) -> DataFrame:
    """The same predicate over frame-of-reference codes."""
    limit = (day or dates.cutoff()).toordinal() + 365 - encodings.FIRST_DAY
    return df.withColumn("ship_off", encodings.day_offset(F.col("l_shipdate"))).filter(F.col("ship_off") <= limit)


def selectivity(df: DataFrame, passes: Column) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count_if(passes)
    return df.agg(k.alias("passing"), n.alias("total"), (k.cast("double") / n).alias("selectivity"))


def filter_bitmap(df: DataFrame, passes: Column) -> DataFrame:
    """One 32-bit word (as bigint) for each 32 rows of a file; bit j of word i says whether row 32 i + j passes."""
    bit = encodings.set_bits(F.col("row_pos"), 1, F.when(passes, 1).otherwise(0))
    return df.groupBy("row_file", (F.col("row_pos") / 32).cast("bigint").alias("word")).agg(F.bit_or(bit).alias("bits"))


def apply_bitmap(df: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows whose bit is set, joined on the word's index."""
    keyed = df.withColumn("word", (F.col("row_pos") / 32).cast("bigint"))
    hit = keyed.join(bitmap, ["row_file", "word"])
    return hit.filter(encodings.bit_get(F.col("bits"), (F.col("row_pos") % 32).cast("int")) == 1).drop("word", "bits")
