"""The pricing summary and the plans that must return the same answer."""

from __future__ import annotations

from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.config import RunOptions
from ledgerlight.functions import encodings
from ledgerlight.operators import aggregates, filters, splits
from ledgerlight.schema import KEYS
from ledgerlight.sources.tables import lineitem


def pricing_summary(df: DataFrame, day: date | None = None) -> DataFrame:
    """Scan, pushed filter, bigint projection, partial and final hash aggregate. The one shuffle carries at
    most six rows a task."""
    kept = df.filter(filters.shipped_by(day))
    return aggregates.finished(aggregates.summed(kept, KEYS, aggregates.terms(kept)))


def wide_decimal(df: DataFrame) -> DataFrame:
    kept = df.filter(filters.shipped_by())
    return aggregates.finished(kept.groupBy(*KEYS).agg(*aggregates.decimal_sums()))


def conditional(df: DataFrame) -> DataFrame:
    return aggregates.finished(aggregates.narrow(aggregates.conditional_sums(df.filter(filters.shipped_by()))))


def morsels(df: DataFrame, rows: int) -> DataFrame:
    states = aggregates.morsel_partials(df.filter(filters.shipped_by()), rows)
    return aggregates.finished(states.groupBy(*KEYS).agg(*aggregates.merged_sums()))


def range_split(df: DataFrame, fraction: float = 0.5, batch: int = 1024) -> DataFrame:
    both = splits.sided(df, fraction, batch).filter(filters.shipped_by())
    return aggregates.finished(splits.merged(both, [*KEYS], aggregates.terms(df)))


def bitmap_filtered(df: DataFrame) -> DataFrame:
    kept = filters.apply_bitmap(df, filters.filter_bitmap(df, filters.shipped_by()))
    return aggregates.finished(aggregates.summed(kept, KEYS, aggregates.terms(df)))


def domain_grouped(df: DataFrame) -> DataFrame:
    """Grouped by one dense id over the observed key domain; keys come back from the id."""
    kept = df.filter(filters.shipped_by())
    ends = df.agg(*(f(F.ascii(k)).alias(f"{n}_{i}") for i, k in enumerate(KEYS) for n, f in (("lo", F.min), ("hi", F.max))))
    keyed = kept.crossJoin(F.broadcast(ends))  # one row, whatever the input
    gid = encodings.domain_group(F.col(KEYS[0]), F.col(KEYS[1]), F.col("lo_0"), F.col("lo_1"), F.col("hi_1"))
    width = F.col("hi_1") - F.col("lo_1") + 1
    sums = keyed.groupBy(gid.alias("gid"), width.alias("width"), "lo_0", "lo_1").agg(*aggregates.fixed_point_sums(kept))
    back = sums.withColumn(KEYS[0], F.chr(F.floor(F.col("gid") / F.col("width")) + F.col("lo_0"))).withColumn(KEYS[1], F.chr(F.col("gid") % F.col("width") + F.col("lo_1")))
    return aggregates.finished(back)


def compressed(df: DataFrame) -> DataFrame:
    """The encoded table: codes, day offsets, whole quantities and cents in narrow integers. Narrowing casts
    raise where a value does not fit."""
    h = {c: aggregates.measures.hundredths(c, df.schema[c].dataType) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    return df.select(
        encodings.narrowed(h["l_quantity"] / 100, "tinyint").alias("qty"),
        encodings.narrowed(h["l_extendedprice"], "int").alias("price"),
        encodings.narrowed(h["l_discount"], "tinyint").alias("disc"),
        encodings.narrowed(h["l_tax"], "tinyint").alias("tax"),
        encodings.narrowed(encodings.dense_group(F.col(KEYS[0]), F.col(KEYS[1])), "tinyint").alias("g"),
        encodings.narrowed(encodings.day_offset(F.col("l_shipdate")), "smallint").alias("ship_off"),
        *(c for c in ("row_file", "row_pos") if c in df.columns),
    )


def encoded(spark: SparkSession, sf_dir: str, *, position: bool = False) -> DataFrame:
    """The encoded table, built once a session and kept by the executors, in memory and then on their disks; what a lost executor
    held is built again. Later plans over the same table read it instead of the source."""
    enc = compressed(lineitem(spark, sf_dir, position=position))
    if enc.storageLevel == StorageLevel.NONE:
        enc.persist(StorageLevel.MEMORY_AND_DISK)
    return enc


#: Fixed value: the cutoff as a day offset.
CUTOFF_OFFSET = 2436


def over_compressed(enc: DataFrame, limit: int = CUTOFF_OFFSET) -> DataFrame:
    """The summary over the encoded table; the limit is the cutoff as a day offset."""
    sums = aggregates.summed(enc.filter(F.col("ship_off") <= limit), ["g"], aggregates.encoded_terms())
    return aggregates.finished(aggregates.encoded_keys(sums))


def compact_checked(enc: DataFrame, limit: int = CUTOFF_OFFSET) -> DataFrame:
    return aggregates.finished(aggregates.compact_checked_sums(enc.filter(F.col("ship_off") <= limit)))


PLANS = {
    "direct": pricing_summary,
    "wide_decimal": wide_decimal,
    "conditional_sums": conditional,
    "morsel_partials": lambda df: morsels(df, 10240),
    "vector_preaggregate": lambda df: morsels(df, 1024),
}


def combined(spark: SparkSession, sf_dir: str, *, encode: bool, bitmap: bool, split: tuple[float, int] | None) -> DataFrame:
    """Over the encoded table or the plain one, filtered by bitmap or by predicate, in two parts (fraction, batch) or in one."""
    position = bitmap or split is not None
    if encode:
        df = encoded(spark, sf_dir, position=position)
        keys, passes, terms = ["g"], F.col("ship_off") <= CUTOFF_OFFSET, aggregates.encoded_terms()
    else:
        df = lineitem(spark, sf_dir, position=position)
        keys, passes, terms = [*KEYS], filters.shipped_by(), aggregates.terms(df)
    both = splits.sided(df, *split) if split else df
    kept = filters.apply_bitmap(both, filters.filter_bitmap(df, passes)) if bitmap else both.filter(passes)
    out = splits.merged(kept, keys, terms) if split else aggregates.summed(kept, keys, terms)
    return aggregates.finished(aggregates.encoded_keys(out) if encode else out)


def planned(spark: SparkSession, o: RunOptions) -> DataFrame:
    """The plan that the options ask for; flags combine."""
    if o.apply_compression or o.use_filter_pushdown or o.use_coprocessing:
        split = (o.cpu_fraction, o.rows_per_launch) if o.use_coprocessing else None
        return combined(spark, o.sf_dir, encode=o.apply_compression, bitmap=o.use_filter_pushdown, split=split)
    return PLANS[o.plan](lineitem(spark, o.sf_dir, position=o.plan in ("morsel_partials", "vector_preaggregate")))
