"""Measures in exact arithmetic.

Fixed point: a measure is held as whole hundredths in a bigint, products are bigints of scale 4
and 6, and all of it stays inside whole-stage code generation. Wide decimal: decimal(15,2) columns
and Spark's own scale tracking, slower and without a width to mind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Split point of a bigint term into a high and a low part.
LOW_BITS = 20
LOW_MASK = (1 << LOW_BITS) - 1


def decimal(c: str) -> Column:
    return F.col(c).cast(T.DecimalType(15, 2))


def hundredths(c: str, kind: T.DataType) -> Column:
    """Whole hundredths as bigint. Doubles are rounded to the nearest; ANSI casts raise on overflow."""
    x = F.col(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.rint(x * F.lit(100.0)).cast("bigint")
    return (x.cast(T.DecimalType(15, 2)) * F.lit(100)).cast("bigint")


def discount_factor(d: Column, one: int = 1) -> Column:
    return F.lit(one) - d


def tax_factor(t: Column, one: int = 1) -> Column:
    return F.lit(one) + t


def disc_price(p: Column, d: Column, one: int = 1) -> Column:
    return p * discount_factor(d, one)


def charge(p: Column, d: Column, t: Column, one: int = 1) -> Column:
    return disc_price(p, d, one) * tax_factor(t, one)


def narrow_minus(a: Column, b: Column) -> Column:
    """Difference of one-byte integers, in one byte."""
    return a.cast("tinyint") - b.cast("tinyint")


def narrow_plus(a: Column, b: Column) -> Column:
    """Sum of one-byte integers, in one byte."""
    return a.cast("tinyint") + b.cast("tinyint")


def wide_times(a: Column, b: Column) -> Column:
    """Product of narrower integers, in eight bytes."""
    return a.cast("bigint") * b.cast("bigint")


def halves(term: Column) -> tuple[Column, Column]:
    """A bigint as high and low part."""
    return F.shiftright(term, LOW_BITS), term.bitwiseAND(F.lit(LOW_MASK))


def from_halves(high: Column, low: Column, scale: int, kind: str) -> Column:
    """What sums of high and low parts stand for, as a decimal of that type."""
    total = high.cast("decimal(30,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low.cast("decimal(30,0)")
    return (total.cast("decimal(30,0)") / F.lit(10**scale).cast("decimal(8,0)")).cast(kind)


def exact_sum(term: Column, scale: int, precision: int) -> Column:
    """Sum of bigint terms as decimal(precision, scale). High and low parts are summed apart as bigints, so
    no realistic row count overflows and the aggregation buffer stays two longs."""
    high = F.sum(F.shiftright(term, LOW_BITS)).cast("decimal(38,0)")
    low = F.sum(term.bitwiseAND(F.lit(LOW_MASK))).cast("decimal(38,0)")
    total = high * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low
    unit = F.lit(10**scale).cast("decimal(8,0)")
    return (total.cast("decimal(30,0)") / unit).cast(T.DecimalType(precision, scale))
