"""Named queries, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import dates, encodings, measures
from ledgerlight.operators import aggregates, filters, stats
from ledgerlight.plans import pricing
from ledgerlight.schema import KEYS, MEASURES
from ledgerlight.sources import text
from ledgerlight.sources.tables import lineitem, prefix

Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[[DataFrame], DataFrame], position: bool = False) -> Query:
    return lambda spark, sf_dir: f(lineitem(spark, sf_dir, position=position))


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*(measures.decimal(c).alias(c) for c in MEASURES), *KEYS, F.col("l_shipdate").cast("date").alias("l_shipdate"))


def _date_threshold(df: DataFrame) -> DataFrame:
    cut = dates.cutoff_column()
    return df.filter(F.col("l_shipdate") <= cut).groupBy(cut.alias("cutoff")).agg(F.count(F.lit(1)).alias("passing"), F.max(F.col("l_shipdate").cast("date")).alias("last_day"))


def _date_number(df: DataFrame) -> DataFrame:
    n = encodings.day_number(F.col("l_shipdate"))
    day = encodings.from_day_number(n)
    return df.groupBy(n.alias("day_number"), encodings.day_offset(F.col("l_shipdate")).alias("day_offset"), day.alias("day"), F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d")).agg(F.count(F.lit(1)).alias("n"))


def _factors(df: DataFrame) -> DataFrame:
    d, t = measures.decimal("l_discount"), measures.decimal("l_tax")
    return df.select(measures.discount_factor(d).cast("decimal(17,2)").alias("disc_1"), measures.tax_factor(t).cast("decimal(17,2)").alias("tax_1")).groupBy("disc_1", "tax_1").agg(F.count(F.lit(1)).alias("n"))


def _prices(df: DataFrame) -> DataFrame:
    _, p, d, t = (measures.hundredths(c, df.schema[c].dataType) for c in MEASURES)
    four, six = F.lit(10**4).cast("decimal(8,0)"), F.lit(10**6).cast("decimal(8,0)")
    return df.select(
        (measures.disc_price(p, d, 100).cast("decimal(18,0)") / four).cast("decimal(18,4)").alias("disc_price"),
        (measures.charge(p, d, t, 100).cast("decimal(18,0)") / six).cast("decimal(18,6)").alias("charge"),
    )


def _codes(df: DataFrame) -> DataFrame:
    f, s = encodings.dict_encode(F.col(KEYS[0]), encodings.FLAG_CODES), encodings.dict_encode(F.col(KEYS[1]), encodings.STATUS_CODES)
    out = df.groupBy(f.alias("flag_code"), s.alias("status_code")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("flag_code", "status_code", encodings.dict_decode(F.col("flag_code"), encodings.FLAG_CODES).alias(KEYS[0]), encodings.dict_decode(F.col("status_code"), encodings.STATUS_CODES).alias(KEYS[1]), "n")


def _grouped(key: Callable[[F.Column, F.Column], F.Column], back: Callable) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        out = df.groupBy(key(F.col(KEYS[0]), F.col(KEYS[1])).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        flag, status = back(F.col("g"))
        return out.select("g", flag.alias(KEYS[0]), status.alias(KEYS[1]), "n")

    return run


def _for_date(df: DataFrame) -> DataFrame:
    return filters.by_day_offset(df).agg(F.count(F.lit(1)).alias("n"), F.max("ship_off").alias("last_off"))


def _int64(df: DataFrame) -> DataFrame:
    kept = df.filter(filters.shipped_by())
    t = aggregates.terms(kept)
    return kept.groupBy(*KEYS).agg(*(F.sum(x).alias(f"{k}_x{10**s}") for k, (x, s) in t.items()), F.count(F.lit(1)).alias("count_order"))


def _checked(df: DataFrame) -> DataFrame:
    return aggregates.finished(aggregates.checked_sums(df.filter(filters.shipped_by())))


def _flagged(df: DataFrame) -> DataFrame:
    return aggregates.flagged_sums(df.filter(filters.shipped_by()))


def _popcount(df: DataFrame) -> DataFrame:
    words = filters.filter_bitmap(df, filters.shipped_by())
    return words.agg(F.sum(F.bit_count("bits")).cast("bigint").alias("passing"), F.sum(F.when(F.col("bits") < 0, 1).otherwise(0)).cast("bigint").alias("negative_words"))


def _bitpack(df: DataFrame) -> DataFrame:
    return stats.unpack_codes(stats.pack_codes(df)).groupBy("flag_code").agg(F.count(F.lit(1)).alias("n"))


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded table, filter bitmap and split together."""
    return pricing.combined(spark, sf_dir, encode=True, bitmap=True, split=(0.5, 1024))


def _wide(df: DataFrame) -> DataFrame:
    return aggregates.conditional_sums(df.filter(filters.shipped_by()))


def _prefix(df: DataFrame) -> DataFrame:
    """A tenth of a table of scale factor 1; of another number of rows, all."""
    return pricing.pricing_summary(prefix(df, 0.1))


def _text(df: DataFrame) -> DataFrame:
    """The summary over rows that were text in between."""
    return pricing.pricing_summary(text.parsed(text.as_text(df)))


def _bit_helpers(df: DataFrame) -> DataFrame:
    """Whole quantities as bits of a word: one bit set, one cleared, three read, three written."""
    q, d, t = (measures.hundredths(c, df.schema[c].dataType) for c in ("l_quantity", "l_discount", "l_tax"))
    w = df.select((q / 100).cast("bigint").alias("word"), d.cast("int").alias("bit"), t.alias("value"))
    bits = {
        "with_bit": encodings.set_bit(F.col("word"), F.col("bit")), "without_bit": encodings.clear_bit(F.col("word"), F.col("bit")),
        "bit_range": encodings.get_bit_range(F.col("word"), F.col("bit"), 3), "with_range": encodings.set_bit_range(F.col("word"), F.col("bit"), 3, F.col("value")),
    }
    return w.groupBy("word", "bit", "value").agg(F.count(F.lit(1)).alias("n")).select("word", "bit", "value", *(x.alias(k) for k, x in bits.items()), "n")


QUERIES: dict[str, Query] = {
    "q1_pricing_summary": _on(pricing.pricing_summary),
    "q1_wide_decimal": _on(pricing.wide_decimal),
    "q1_scan_project": _on(_rows),
    "q1_filter_shipdate": _on(lambda df: _rows(df.filter(filters.shipped_by()))),
    "q1_filter_for_date": _on(_for_date),
    "q1_selectivity": _on(lambda df: filters.selectivity(df, filters.shipped_by())),
    "q1_column_stats": _on(stats.column_stats),
    "q1_date_number": _on(_date_number),
    "q1_date_threshold": _on(_date_threshold),
    "q1_discount_tax_factors": _on(_factors),
    "q1_disc_price_charge": _on(_prices),
    "q1_dict_codes": _on(_codes),
    "q1_group_dense": _on(_grouped(encodings.dense_group, encodings.dense_keys)),
    "q1_group_packed": _on(_grouped(encodings.packed_group, encodings.packed_keys)),
    "q1_group_domain": _on(pricing.domain_grouped),
    "q1_extant_groups": _on(lambda df: stats.extant_groups(df.filter(filters.shipped_by()))),
    "q1_int64_fixed_point": _on(_int64),
    "q1_compressed": lambda spark, sf_dir: pricing.over_compressed(pricing.encoded(spark, sf_dir)),
    "q1_compact_checked": lambda spark, sf_dir: pricing.compact_checked(pricing.encoded(spark, sf_dir)),
    "q1_compressed_once": _on(lambda df: pricing.over_compressed(pricing.compressed(df))),
    "q1_compressed_bitmap_split": _combined,
    "q1_text_ingest": _on(_text),
    "q1_bit_helpers": _on(_bit_helpers),
    "q1_overflow_checked": _on(_checked),
    "q1_overflow_flag": _on(_flagged),
    "q1_conditional_sums": _on(_wide),
    "q1_conditional_rows": _on(pricing.conditional),
    "q1_morsel_partials": _on(pricing.PLANS["morsel_partials"], True),
    "q1_vector_preaggregate": _on(pricing.PLANS["vector_preaggregate"], True),
    "q1_range_split_merge": _on(pricing.range_split, True),
    "q1_filter_bitmap_popcount": _on(_popcount, True),
    "q1_filter_bitmap_agg": _on(pricing.bitmap_filtered, True),
    "q1_bitpack_flags": _on(_bitpack, True),
    "q1_prefix_sample": _on(_prefix, True),
}

# --- the same in ANSI SQL -------------------------------------------------------------------------------------

_V = """WITH v AS (SELECT CAST(l_quantity AS DECIMAL(15,2)) AS q, CAST(l_extendedprice AS DECIMAL(15,2)) AS p,
 CAST(l_discount AS DECIMAL(15,2)) AS d, CAST(l_tax AS DECIMAL(15,2)) AS t, l_returnflag, l_linestatus,
 CAST(l_shipdate AS DATE) AS sd FROM lineitem)"""
_W = " WHERE sd <= DATE '1998-12-01' - INTERVAL 90 DAY"
_SUMS = """CAST(sum(q) AS DECIMAL(25,2)) AS sum_qty, CAST(sum(p) AS DECIMAL(25,2)) AS sum_base_price,
 CAST(sum(p * (1 - d)) AS DECIMAL(38,4)) AS sum_disc_price, CAST(sum(p * (1 - d) * (1 + t)) AS DECIMAL(38,6)) AS sum_charge,
 CAST(sum(d) AS DECIMAL(25,2)) AS sum_disc"""
_AVGS = """CAST(CAST(sum(q) AS DECIMAL(25,2)) AS DOUBLE) / count(*) AS avg_qty, CAST(CAST(sum(p) AS DECIMAL(25,2)) AS DOUBLE) / count(*) AS avg_price,
 CAST(CAST(sum(d) AS DECIMAL(25,2)) AS DOUBLE) / count(*) AS avg_disc"""
_Q1 = f"{_V} SELECT l_returnflag, l_linestatus, {_SUMS}, {_AVGS}, count(*) AS count_order FROM v{_W} GROUP BY ALL"
_ROWS = f"{_V} SELECT q AS l_quantity, p AS l_extendedprice, d AS l_discount, t AS l_tax, l_returnflag, l_linestatus, sd AS l_shipdate FROM v"
_FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END"
_STATUS = "CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END"
_DAYS = "date_diff('day', DATE '1970-01-01', sd) + 719528"


def _wide_sql() -> str:
    cols = []
    for k in range(6):
        on = f"FILTER (WHERE 2 * {_FLAG} + {_STATUS} = {k})"
        for name, x in (("sum_qty", "q"), ("sum_base_price", "p"), ("sum_disc_price", "p * (1 - d)"), ("sum_charge", "p * (1 - d) * (1 + t)"), ("sum_disc", "d")):
            cols.append(f"CAST(coalesce(sum({x}) {on}, 0) AS {aggregates.SUMS[name]}) AS {name}_{k}")
        cols.append(f"count(*) {on} AS count_order_{k}")
    return f"{_V} SELECT {', '.join(cols)} FROM v{_W}"


ORACLE: dict[str, str] = {
    **dict.fromkeys(
        ("q1_pricing_summary", "q1_wide_decimal", "q1_group_domain", "q1_compressed", "q1_overflow_checked", "q1_compact_checked", "q1_compressed_once", "q1_compressed_bitmap_split", "q1_text_ingest", "q1_prefix_sample", "q1_conditional_rows", "q1_morsel_partials", "q1_vector_preaggregate", "q1_range_split_merge", "q1_filter_bitmap_agg"), _Q1
    ),
    "q1_scan_project": _ROWS,
    "q1_filter_shipdate": _ROWS + _W,
    "q1_filter_for_date": f"{_V} SELECT count(*) AS n, CAST(max({_DAYS} - 727563) AS INTEGER) AS last_off FROM v WHERE {_DAYS} - 727563 <= 2436",
    "q1_selectivity": f"{_V} SELECT count(*) FILTER ({_W.strip()}) AS passing, count(*) AS total, CAST(count(*) FILTER ({_W.strip()}) AS DOUBLE) / count(*) AS selectivity FROM v",
    "q1_column_stats": f"{_V} SELECT {', '.join(f'{f}({x}) AS {f}_{c}' for x, c in zip(('q', 'p', 'd', 't', 'l_returnflag', 'l_linestatus', 'sd'), (*MEASURES, *KEYS, 'l_shipdate'), strict=True) for f in ('min', 'max'))} FROM v",
    "q1_date_number": f"{_V} SELECT CAST({_DAYS} AS INTEGER) AS day_number, CAST({_DAYS} - 727563 AS INTEGER) AS day_offset, sd AS day, CAST(year(sd) AS INTEGER) AS y, CAST(month(sd) AS INTEGER) AS m, CAST(day(sd) AS INTEGER) AS d, count(*) AS n FROM v GROUP BY ALL",
    "q1_date_threshold": f"{_V} SELECT CAST(DATE '1998-12-01' - INTERVAL 90 DAY AS DATE) AS cutoff, count(*) AS passing, max(sd) AS last_day FROM v{_W}",
    "q1_discount_tax_factors": f"{_V} SELECT CAST(1 - d AS DECIMAL(17,2)) AS disc_1, CAST(1 + t AS DECIMAL(17,2)) AS tax_1, count(*) AS n FROM v GROUP BY ALL",
    "q1_disc_price_charge": f"{_V} SELECT CAST(p * (1 - d) AS DECIMAL(18,4)) AS disc_price, CAST(p * (1 - d) * (1 + t) AS DECIMAL(18,6)) AS charge FROM v",
    "q1_dict_codes": f"SELECT CAST({_FLAG} AS INTEGER) AS flag_code, CAST({_STATUS} AS INTEGER) AS status_code, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "q1_group_dense": f"SELECT CAST(2 * {_FLAG} + {_STATUS} AS INTEGER) AS g, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "q1_group_packed": "SELECT CAST(ascii(l_returnflag) * 256 + ascii(l_linestatus) AS INTEGER) AS g, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "q1_extant_groups": f"{_V} SELECT count(*) AS groups FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM v{_W})",
    "q1_int64_fixed_point": f"{_V} SELECT l_returnflag, l_linestatus, CAST(sum(q) * 100 AS BIGINT) AS sum_qty_x100, CAST(sum(p) * 100 AS BIGINT) AS sum_base_price_x100, CAST(sum(p * (1 - d)) * 10000 AS BIGINT) AS sum_disc_price_x10000, CAST(sum(p * (1 - d) * (1 + t)) * 1000000 AS BIGINT) AS sum_charge_x1000000, CAST(sum(d) * 100 AS BIGINT) AS sum_disc_x100, count(*) AS count_order FROM v{_W} GROUP BY ALL",
    "q1_overflow_flag": f"{_V} SELECT l_returnflag, l_linestatus, {_SUMS}, count(*) AS count_order, false AS overflowed FROM v{_W} GROUP BY ALL",
    "q1_conditional_sums": _wide_sql(),
    "q1_filter_bitmap_popcount": f"{_V} SELECT count(*) AS passing, CAST(0 AS BIGINT) AS negative_words FROM v{_W}",
    "q1_bit_helpers": "WITH w AS (SELECT CAST(l_quantity AS BIGINT) AS word, CAST(round(l_discount * 100) AS INTEGER) AS bit, CAST(round(l_tax * 100) AS BIGINT) AS value FROM lineitem) SELECT word, bit, value, word | (CAST(1 AS BIGINT) << bit) AS with_bit, word & ~(CAST(1 AS BIGINT) << bit) AS without_bit, (word >> bit) & 7 AS bit_range, (word & ~(CAST(7 AS BIGINT) << bit)) | ((value & 7) << bit) AS with_range, count(*) AS n FROM w GROUP BY ALL",
    "q1_bitpack_flags": f"SELECT CAST({_FLAG} AS INTEGER) AS flag_code, count(*) AS n FROM lineitem GROUP BY ALL",
}
