"""Schemas: the public TPC-H lineitem text layout, and the columns the pricing summary reads."""

from __future__ import annotations

from pyspark.sql import types as T

_DEC = T.DecimalType(15, 2)

#: Pipe-delimited text: sixteen fields and the empty one after the trailing delimiter.
LINEITEM_TEXT = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", _DEC),
        T.StructField("l_extendedprice", _DEC),
        T.StructField("l_discount", _DEC),
        T.StructField("l_tax", _DEC),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.DateType()),
        T.StructField("l_commitdate", T.DateType()),
        T.StructField("l_receiptdate", T.DateType()),
        T.StructField("l_shipinstruct", T.StringType()),
        T.StructField("l_shipmode", T.StringType()),
        T.StructField("l_comment", T.StringType()),
        T.StructField("_end", T.StringType()),
    ]
)

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
KEYS = ("l_returnflag", "l_linestatus")
Q1_COLUMNS = (*MEASURES, *KEYS, "l_shipdate")
