"""Column statistics, group counts and bit-packed codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import encodings
from ledgerlight.schema import KEYS, MEASURES


def column_stats(df: DataFrame) -> DataFrame:
    """Minimum and maximum of each column, in one pass: of the raw numbers by key pair, in generated code, and then of the
    few pairs; only the one row that is left is cast."""
    ends = (("min", F.min), ("max", F.max))
    by = df.groupBy(*KEYS).agg(*(f(c).alias(f"{n}_{c}") for c in (*MEASURES, "l_shipdate") for n, f in ends))
    one = by.agg(*(f(c if c in KEYS else f"{n}_{c}").alias(f"{n}_{c}") for c in (*MEASURES, *KEYS, "l_shipdate") for n, f in ends))
    kind = dict.fromkeys(MEASURES, "decimal(15,2)") | dict.fromkeys(KEYS, "string") | {"l_shipdate": "date"}
    return one.select(*(F.col(f"{n}_{c}").cast(kind[c]).alias(f"{n}_{c}") for c in kind for n, _ in ends))


def extant_groups(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").agg(F.count(F.lit(1)).alias("groups"))


def pack_codes(df: DataFrame) -> DataFrame:
    """Sixteen two-bit return-flag codes to a word."""
    code = encodings.dict_encode(F.col("l_returnflag"), encodings.FLAG_CODES)
    return df.groupBy("row_file", (F.col("row_pos") / 16).cast("bigint").alias("word")).agg(F.bit_or(encodings.set_bits(F.col("row_pos"), 2, code)).alias("bits"), F.count(F.lit(1)).alias("used"))


def unpack_codes(packed: DataFrame) -> DataFrame:
    """A row for each packed code."""
    at = packed.select("bits", F.explode(F.sequence(F.lit(0), (F.col("used") - 1).cast("int"))).alias("at"))
    return at.select(encodings.get_bits(F.col("bits"), F.col("at"), 2).cast("int").alias("flag_code"))
