"""Pricing aggregates: direct, partial and merged, conditional, overflow-checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import encodings, measures
from ledgerlight.schema import KEYS, MEASURES

#: Column of each sum: name, type.
SUMS = {"sum_qty": "decimal(25,2)", "sum_base_price": "decimal(25,2)", "sum_disc_price": "decimal(38,4)", "sum_charge": "decimal(38,6)", "sum_disc": "decimal(25,2)"}


def terms(df: DataFrame) -> dict[str, tuple[Column, int]]:
    """Each sum's bigint term and its scale."""
    q, p, d, t = (measures.hundredths(c, df.schema[c].dataType) for c in MEASURES)
    return {"sum_qty": (q, 2), "sum_base_price": (p, 2), "sum_disc_price": (measures.disc_price(p, d, 100), 4), "sum_charge": (measures.charge(p, d, t, 100), 6), "sum_disc": (d, 2)}


def fixed_point_sums(df: DataFrame) -> list[Column]:
    out = []
    for name, (term, scale) in terms(df).items():
        precision = int(SUMS[name].split("(")[1].split(",")[0])
        out.append(measures.exact_sum(term, scale, precision).alias(name))
    return [*out, F.count(F.lit(1)).alias("count_order")]


def summed(df: DataFrame, keys: Sequence[str], terms_: dict[str, tuple[Column, int]]) -> DataFrame:
    """keys, the exact sum of each bigint term, count_order. Like fixed_point_sums, in three small steps (parts of the terms,
    their sums, decimals of the few sums), which are quicker to plan than one with everything."""
    parts = [x.alias(f"{half}_{k}") for k, (t, _) in terms_.items() for half, x in zip(("high", "low"), measures.halves(t), strict=True)]
    names = [f"{half}_{k}" for k in terms_ for half in ("high", "low")]
    sums = df.select(*keys, *parts).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names), F.count(F.lit(1)).alias("count_order"))
    return sums.select(*keys, *(measures.from_halves(F.col(f"high_{k}"), F.col(f"low_{k}"), s, SUMS[k]).alias(k) for k, (_, s) in terms_.items()), "count_order")


def decimal_sums(_: DataFrame | None = None) -> list[Column]:
    q, p, d, t = (measures.decimal(c) for c in MEASURES)
    exprs = {"sum_qty": q, "sum_base_price": p, "sum_disc_price": measures.disc_price(p, d), "sum_charge": measures.charge(p, d, t), "sum_disc": d}
    return [*(F.sum(x).cast(SUMS[k]).alias(k) for k, x in exprs.items()), F.count(F.lit(1)).alias("count_order")]


def merged_sums() -> list[Column]:
    """Adds partial states of the same groups."""
    return [*(F.sum(k).cast(kind).alias(k) for k, kind in SUMS.items()), F.sum("count_order").cast("bigint").alias("count_order")]


def finished(df: DataFrame) -> DataFrame:
    """Adds the averages, as double sum over count so that every engine agrees to the bit."""
    avg = {"avg_qty": "sum_qty", "avg_price": "sum_base_price", "avg_disc": "sum_disc"}
    return df.select(*KEYS, *SUMS, *((F.col(s).cast("double") / F.col("count_order")).alias(a) for a, s in avg.items()), "count_order")


def morsel_partials(df: DataFrame, rows: int) -> DataFrame:
    """State of each (row range, group); at most six rows for each range."""
    morsel = (F.col("row_pos") / rows).cast("bigint").alias("morsel")
    return df.groupBy("row_file", morsel, *KEYS).agg(*fixed_point_sums(df))


def conditional_sums(df: DataFrame) -> DataFrame:
    """One wide row: every aggregate of every dense group as a conditional sum, zero for a group without rows. Rows are added
    up by group first, so that the 36 conditions look at six rows and the code over the table stays small."""
    sums = grouped_sums(df)
    row = sums.agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct(*SUMS, "count_order")))).alias("of"))  # six entries at most
    kinds = [*SUMS.items(), ("count_order", "bigint")]
    return row.select(*(F.coalesce(F.try_element_at("of", F.lit(k))[name], F.lit(0).cast(kind)).alias(f"{name}_{k}") for k in range(6) for name, kind in kinds))


def grouped_sums(df: DataFrame) -> DataFrame:
    """The sums of each dense group g."""
    return summed(df.withColumn("g", encodings.dense_group(F.col(KEYS[0]), F.col(KEYS[1]))), ["g"], terms(df))


def narrow(wide: DataFrame) -> DataFrame:
    """Rows of a wide conditional-sum row; groups without rows are left out."""
    group = [F.struct(F.lit(k).alias("g"), *(F.col(f"{n}_{k}").alias(n) for n in [*SUMS, "count_order"])) for k in range(6)]
    rows = wide.select(F.explode(F.array(*group)).alias("x")).select("x.*").filter("count_order > 0")
    flag, status = encodings.dense_keys(F.col("g"))
    return rows.select(flag.alias(KEYS[0]), status.alias(KEYS[1]), *SUMS, "count_order")


def encoded_terms() -> dict[str, tuple[Column, int]]:
    """The terms from the encoded columns qty, price, disc, tax."""
    p, d, t = (F.col(c).cast("bigint") for c in ("price", "disc", "tax"))
    return {"sum_qty": (F.col("qty").cast("bigint") * 100, 2), "sum_base_price": (p, 2), "sum_disc_price": (measures.disc_price(p, d, 100), 4), "sum_charge": (measures.charge(p, d, t, 100), 6), "sum_disc": (d, 2)}


def encoded_keys(sums: DataFrame) -> DataFrame:
    """The key columns of sums by dense group g."""
    flag, status = encodings.dense_keys(F.col("g").cast("int"))
    return sums.withColumn(KEYS[0], flag).withColumn(KEYS[1], status)


def compact_checked_sums(enc: DataFrame) -> DataFrame:
    """Overflow-checked at the width of each column: 100 - discount and 100 + tax in one byte, their products with the price
    in eight; every step raises in ANSI mode where its result doesn't fit."""
    one = F.lit(100).cast("tinyint")
    off, on = measures.narrow_minus(one, F.col("disc")), measures.narrow_plus(one, F.col("tax"))
    dp = measures.wide_times(F.col("price"), off)
    cols = {"sum_qty": (F.col("qty").cast("bigint") * 100, 2), "sum_base_price": (F.col("price").cast("bigint"), 2), "sum_disc_price": (dp, 4), "sum_charge": (measures.wide_times(dp, on), 6), "sum_disc": (F.col("disc").cast("bigint"), 2)}
    out = enc.groupBy("g").agg(*(F.sum(x).alias(k) for k, (x, _) in cols.items()), F.count(F.lit(1)).alias("count_order"))
    true = ((F.col(k).cast("decimal(30,0)") / F.lit(10**s).cast("decimal(8,0)")).cast(SUMS[k]).alias(k) for k, (_, s) in cols.items())
    return encoded_keys(out.select("g", *true, "count_order"))


def checked_sums(df: DataFrame) -> DataFrame:
    """Bigint sums that raise on overflow in ANSI mode; true scales by one division at the end."""
    t = terms(df)
    aggs = [F.sum(x).alias(k) for k, (x, _) in t.items()]
    out = df.groupBy(*KEYS).agg(*aggs, F.count(F.lit(1)).alias("count_order"))
    return out.select(*KEYS, *((F.col(k).cast("decimal(30,0)") / F.lit(10**s).cast("decimal(8,0)")).cast(SUMS[k]).alias(k) for k, (_, s) in t.items()), "count_order")


def flagged_sums(df: DataFrame) -> DataFrame:
    """Deferred check: overflow turns a try_ result to null, and one flag at the end says whether any did."""
    q, p, d, t = (measures.hundredths(c, df.schema[c].dataType) for c in MEASURES)
    dp = F.try_multiply(p, F.try_subtract(F.lit(100), d))
    ch = F.try_multiply(dp, F.try_add(F.lit(100), t))
    v = df.select(*KEYS, q.alias("q"), p.alias("p"), d.alias("d"), dp.alias("dp"), ch.alias("ch"), ((p.isNotNull() & d.isNotNull() & dp.isNull()) | (dp.isNotNull() & t.isNotNull() & ch.isNull())).alias("over"))
    cols = {"sum_qty": ("q", 2), "sum_base_price": ("p", 2), "sum_disc_price": ("dp", 4), "sum_charge": ("ch", 6), "sum_disc": ("d", 2)}
    sums = [F.try_sum(c).alias(k) for k, (c, _) in cols.items()]
    lost = [F.count(c) for c, _ in cols.values()]
    out = v.groupBy(*KEYS).agg(*sums, *(x.alias(f"n_{k}") for x, k in zip(lost, cols, strict=True)), F.count(F.lit(1)).alias("count_order"), F.bool_or("over").alias("over"))
    flag = F.col("over")
    for k in cols:
        flag = flag | (F.col(k).isNull() & (F.col(f"n_{k}") > 0))
    return out.select(*KEYS, *((F.col(k).cast("decimal(30,0)") / F.lit(10**s).cast("decimal(8,0)")).cast(SUMS[k]).alias(k) for k, (_, s) in cols.items()), "count_order", flag.alias("overflowed"))
