"""Light-weight encodings: dictionary codes, frame of reference, narrowing, bit packing, group ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dictionaries of the two key columns, day number of 1970-01-01, of 1992-01-01.
FLAG_CODES = {"A": 0, "N": 1, "R": 2}
STATUS_CODES = {"F": 0, "O": 1}
EPOCH_DAY = 719528
FIRST_DAY = 727563


def dict_encode(c: Column, codes: dict[str, int]) -> Column:
    """Code of a value; an unknown value raises, null stays null."""
    whens = reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), codes.items(), F.when(c.isNull(), F.lit(None).cast("int")))
    return whens.otherwise(F.raise_error(F.concat(F.lit("no code for "), c)))


def dict_decode(c: Column, codes: dict[str, int]) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[1], F.lit(kv[0])), codes.items(), F.when(c.isNull(), F.lit(None).cast("string")))


def day_number(d: Column) -> Column:
    """Days of the proleptic Gregorian calendar from year 0."""
    return F.unix_date(d.cast("date")) + F.lit(EPOCH_DAY)


def day_offset(d: Column) -> Column:
    """Frame of reference: days since 1992-01-01."""
    return day_number(d) - F.lit(FIRST_DAY)


def from_day_number(n: Column) -> Column:
    return F.date_from_unix_date((n - F.lit(EPOCH_DAY)).cast("int"))


def narrowed(c: Column, kind: str) -> Column:
    """A narrower integer; the ANSI cast raises where the value doesn't fit."""
    return c.cast(kind)


def dense_group(flag: Column, status: Column) -> Column:
    return F.shiftleft(dict_encode(flag, FLAG_CODES), 1) + dict_encode(status, STATUS_CODES)


def dense_keys(g: Column) -> tuple[Column, Column]:
    return dict_decode(F.shiftright(g, 1), FLAG_CODES), dict_decode(g.bitwiseAND(F.lit(1)), STATUS_CODES)


def packed_group(flag: Column, status: Column) -> Column:
    return F.ascii(flag) * F.lit(256) + F.ascii(status)


def packed_keys(g: Column) -> tuple[Column, Column]:
    return F.chr(F.shiftright(g, 8)), F.chr(g.bitwiseAND(F.lit(255)))


def domain_group(flag: Column, status: Column, low_flag: Column, low_status: Column, high_status: Column) -> Column:
    """Dense id over the observed domain; the row width is max - min + 1, so ids never collide."""
    return (F.ascii(flag) - low_flag) * (high_status - low_status + F.lit(1)) + (F.ascii(status) - low_status)


def bit_get(word: Column, bit: Column) -> Column:
    return F.call_function("getbit", word, bit)


def _ones(width: Column | int) -> Column:
    """The lowest width bits, for 0 to 62 of them."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(width).cast("int") if isinstance(width, int) else width) - F.lit(1).cast("bigint")


def set_bit(word: Column, bit: Column) -> Column:
    """A bigint with that bit on."""
    return word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))


def clear_bit(word: Column, bit: Column) -> Column:
    """A bigint with that bit off."""
    return word.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)))


def get_bit_range(word: Column, first: Column, width: Column | int) -> Column:
    """The number in width bits from first on."""
    return F.call_function("shiftrightunsigned", word, first).bitwiseAND(_ones(width))


def set_bit_range(word: Column, first: Column, width: Column | int, value: Column) -> Column:
    """A bigint with a number in width bits from first on; higher bits of the number are left out."""
    hole = word.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", _ones(width), first)))
    return hole.bitwiseOR(F.call_function("shiftleft", value.cast("bigint").bitwiseAND(_ones(width)), first))


def set_bits(position: Column, bits: int, code: Column) -> Column:
    """The code of one element, shifted to its place in a 32-bit word held as bigint."""
    place = (position % F.lit(32 // bits)).cast("int") * F.lit(bits)
    return F.call_function("shiftleft", code.cast("bigint"), place)


def get_bits(word: Column, position: Column, bits: int) -> Column:
    place = (position % F.lit(32 // bits)).cast("int") * F.lit(bits)
    return F.call_function("shiftright", word, place).bitwiseAND(F.lit((1 << bits) - 1))
