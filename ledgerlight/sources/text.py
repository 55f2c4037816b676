"""Strict ingest of pipe-delimited lineitem text, and the Parquet cache in front of it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.schema import KEYS, LINEITEM_TEXT, MEASURES, Q1_COLUMNS


_OPTIONS = {"sep": "|", "mode": "FAILFAST", "dateFormat": "yyyy-MM-dd", "enableDateTimeParsingFallback": "false"}


def _strict(raw: DataFrame) -> DataFrame:
    """The seven columns; keys that are not one character raise."""
    one = {k: F.when(F.length(k) == 1, F.col(k)).otherwise(F.raise_error(F.concat(F.lit(f"{k} must be one character: "), F.coalesce(k, F.lit("null"))))) for k in KEYS}
    return raw.select(*(one[c].alias(c) if c in one else c for c in Q1_COLUMNS))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The seven columns of lineitem text. Malformed numbers, dates and row shapes, and keys that
    are not one character, raise; nothing turns into null."""
    return _strict(spark.read.schema(LINEITEM_TEXT).options(**_OPTIONS).csv(path))


def parsed(lines: DataFrame) -> DataFrame:
    """The same from lines that are at hand already: one column, a line of text in each row."""
    fields = F.from_csv(lines[lines.columns[0]], LINEITEM_TEXT.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), _OPTIONS)
    return _strict(lines.select(fields.alias("f")).select("f.*"))


def as_text(df: DataFrame) -> DataFrame:
    """Lines of lineitem text with the seven columns of df; fields that nothing reads are filled with constants."""
    shown = {c: F.col(c).cast("decimal(15,2)").cast("string") for c in MEASURES} | {c: F.col(c) for c in KEYS} | {"l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd")}
    rest = {T.LongType(): "1", T.IntegerType(): "1", T.DateType(): "1998-01-01", T.StringType(): "-"}
    fields = [shown.get(f.name, F.lit("" if f.name == "_end" else rest.get(f.dataType, "0"))) for f in LINEITEM_TEXT.fields]
    return df.select(F.concat_ws("|", *fields).alias("line"))


def _readable(spark: SparkSession, path: str) -> DataFrame | None:
    """None if nothing is at the path; anything else that is wrong with it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def cached_or_text(spark: SparkSession, text_path: str, cache_path: str) -> DataFrame:
    """The Parquet cache where there is one, else parse the text and write the cache, which must not be there yet. Spark's
    commit protocol leaves no half-written cache behind. Both paths can be in any store that Spark reads."""
    if (hit := _readable(spark, cache_path)) is not None:
        return hit.select(*Q1_COLUMNS)
    read_text(spark, text_path).write.parquet(cache_path)
    return spark.read.parquet(cache_path)
