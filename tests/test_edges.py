"""Inline edge cases, splits at every place, plans, ingest and options."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlight import cli
from ledgerlight.config import RunOptions
from ledgerlight.functions import dates, encodings
from ledgerlight.operators import aggregates, filters, splits, stats
from ledgerlight.plans import pricing
from ledgerlight.sources import sinks, text
from ledgerlight.sources.tables import lineitem

SCHEMA = "l_quantity decimal(15,2), l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), l_returnflag string, l_linestatus string, l_shipdate date"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(q="1", p="100.01", d="0.05", t="0.07", f="A", s="F", day=date(1998, 9, 2)):
    return (D(q), D(p), D(d), D(t), f, s, day)


def positioned(df):
    n = df.count()
    return df.coalesce(1).select("*", F.lit("f").alias("row_file"), F.monotonically_increasing_id().alias("row_pos")), n


def test_boundary_null_and_scales(spark):
    df = frame(spark, [row(), row(day=date(1998, 9, 3)), row(day=None)])
    (r,) = pricing.pricing_summary(df).collect()
    assert (r.sum_disc_price, r.sum_charge, r.count_order) == (D("95.0095"), D("101.660165"), 1)
    assert r.sum_disc == D("0.05") and r.avg_qty == 1.0


@pytest.mark.parametrize("rows", [[], [row(day=date(1999, 1, 1))]])
def test_no_groups(spark, rows):
    df = frame(spark, rows)
    pos, _ = positioned(df)
    assert pricing.pricing_summary(df).count() == pricing.conditional(df).count() == pricing.morsels(pos, 7).count() == 0


def test_six_groups(spark):
    df = frame(spark, [row(f=f, s=s) for f in "ANR" for s in "FO"])
    assert pricing.pricing_summary(df).count() == pricing.over_compressed(pricing.compressed(df)).count() == 6


@pytest.mark.parametrize("n", [33, 1024, 1025])
def test_positions(spark, n):
    df = frame(spark, [row(q=str(i % 50 + 1), f="ANR"[i % 3], s="FO"[i % 2], day=date(1998, 8, 1 + i % 31) if i % 4 else date(1999, 1, 1)) for i in range(n)])
    pos, _ = positioned(df)
    want = sorted(map(tuple, pricing.pricing_summary(df).collect()))
    for plan in (lambda x: pricing.morsels(x, 1024), pricing.bitmap_filtered, *(lambda x, c=c: pricing.range_split(x, c, 8) for c in (0, 0.5, 1))):
        assert sorted(map(tuple, plan(pos).collect())) == want
    words = filters.filter_bitmap(pos, filters.shipped_by()).collect()
    assert len(words) == -(-n // 32) and all(w.bits >= 0 for w in words)
    assert stats.unpack_codes(stats.pack_codes(pos)).count() == n
    head, tail = splits.split_at_fraction(pos, 0.3, 16)
    assert head.count() + tail.count() == n and head.count() % 16 == 0


def test_bitmap_bit_31(spark):
    pos, _ = positioned(frame(spark, [row(day=date(1999, 1, 1))] * 31 + [row()]))
    (w,) = filters.filter_bitmap(pos, filters.shipped_by()).collect()
    assert w.bits == 1 << 31


def test_overflow(spark):
    with pytest.raises(Exception, match="CAST_OVERFLOW|out of range"):
        pricing.compressed(frame(spark, [row(q="300")])).collect()
    big = frame(spark, [row(p="9000000000000.00", d="0", t="0")] * 3)
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW|overflow"):
        aggregates.checked_sums(big).collect()
    (r,) = aggregates.flagged_sums(big).collect()
    assert r.overflowed
    (ok,) = aggregates.flagged_sums(frame(spark, [row()])).collect()
    assert not ok.overflowed


def test_unknown_code(spark):
    with pytest.raises(Exception, match="no code for"):
        pricing.compressed(frame(spark, [row(f="X")])).collect()


def test_dates(spark):
    assert dates.cutoff() == date(1998, 9, 2)
    df = spark.createDataFrame([(date(1992, 1, 1),), (date(1998, 9, 2),)], "l_shipdate date")
    got = df.select(encodings.day_number(F.col("l_shipdate")).alias("n"), encodings.day_offset(F.col("l_shipdate")).alias("o")).collect()
    assert [tuple(r) for r in got] == [(727563, 0), (729999, 2436)]


LINE = "1|2|3|4|{q}|100.01|0.05|0.07|{f}|F|{day}|1998-01-01|1998-01-01|NONE|AIR|text|\n"


def test_text(spark, tmp_path):
    src, cache = tmp_path / "lineitem.tbl", str(tmp_path / "cache")
    src.write_text("".join(LINE.format(q=q, f="A", day="1998-09-02") for q in ("0.1", "-5.25", "17")))
    df = text.cached_or_text(spark, str(src), cache)
    assert sorted(r.l_quantity for r in df.collect()) == [D("-5.25"), D("0.10"), D("17.00")]
    src.unlink()
    assert text.cached_or_text(spark, str(src), cache).count() == 3


def test_cache_is_not_replaced(spark, tmp_path):
    """A path that holds something else is an error, not a missing cache."""
    (tmp_path / "l.tbl").write_text(LINE.format(q="1", f="A", day="1998-09-02"))
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_text("not Parquet")
    with pytest.raises(Exception):
        text.cached_or_text(spark, str(tmp_path / "l.tbl"), str(tmp_path / "cache")).count()
    assert (tmp_path / "cache" / "part-0.parquet").read_text() == "not Parquet"


def test_bits(spark):
    df = spark.createDataFrame([(0b101101, 2, 3, 0b1010)], "w bigint, a int, n int, v bigint")
    w, a = F.col("w"), F.col("a")
    got = df.select(encodings.set_bit(w, F.lit(1)), encodings.clear_bit(w, F.lit(0)), encodings.get_bit_range(w, a, F.col("n")), encodings.set_bit_range(w, a, F.col("n"), F.col("v")), encodings.set_bit(w, F.lit(63)), encodings.get_bit_range(F.lit(-1).cast("bigint"), F.lit(60), 4)).first()
    assert tuple(got) == (0b101111, 0b101100, 0b011, 0b101001, 0b101101 - 2**63, 15)


def test_compact_overflow(spark):
    enc = spark.createDataFrame([(1, 100, -100, 0, 0, 0)], "qty tinyint, price int, disc tinyint, tax tinyint, g tinyint, ship_off smallint")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        pricing.compact_checked(enc).collect()


@pytest.mark.parametrize("bad", [{"day": "1998-02-31"}, {"f": "AN"}, {"q": "x"}])
def test_bad_text(spark, tmp_path, bad):
    (tmp_path / "l.tbl").write_text(LINE.format(**{"q": "1", "f": "A", "day": "1998-09-02"} | bad))
    with pytest.raises(Exception):
        text.read_text(spark, str(tmp_path / "l.tbl")).collect()


def test_plan_pushes_and_prunes(spark):
    df = pricing.pricing_summary(lineitem(spark, "/root/testdata/sf0.01"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_orderkey" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("bad", [{"scale_factor": 0.0001}, {"runs": 0}, {"cpu_fraction": 1.5}, {"use_filter_pushdown": True}, {"plan": "x"}, {"plan": "wide_decimal", "apply_compression": True}, {"plan": "morsel_partials", "use_coprocessing": True}])
def test_options(bad):
    with pytest.raises(ValueError):
        RunOptions(**bad)


@pytest.mark.parametrize("flags", [[], ["--apply-compression"], ["--apply-compression", "--use-filter-pushdown"], ["--use-coprocessing", "--cpu-fraction=0.3"], ["--apply-compression", "--use-coprocessing"], ["--apply-compression", "--use-filter-pushdown", "--use-coprocessing", "--tuples-per-kernel-launch=64"], ["--plan=morsel_partials"], ["--plan=wide_decimal"], ["--plan=conditional_sums"]])
def test_cli_plans_agree(spark, flags):
    options, _ = cli.parse(["--scale-factor=0.001", *flags])
    want = sinks.result_lines(pricing.pricing_summary(lineitem(spark, options.sf_dir)))
    assert sinks.result_lines(pricing.planned(spark, options)) == want


def test_stream(spark, tmp_path):
    from ledgerlight.streaming.pricing import streamed

    batch = frame(spark, [row(), row(f="N")])
    batch.write.parquet(str(tmp_path / "in"))
    q = streamed(spark, str(tmp_path / "in"), batch.schema).writeStream.format("memory").queryName("pricing").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pricing").count() == 2


def test_timings(tmp_path):
    sinks.write_timings(str(tmp_path / "r.csv"), [0.5])
    assert (tmp_path / "r.csv").read_text().strip() == "0.500000"
