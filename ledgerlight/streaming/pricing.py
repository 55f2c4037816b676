"""The pricing summary over a stream of lineitem files: an extension, not part of the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlight.operators import aggregates, filters
from ledgerlight.schema import KEYS


def streamed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Incremental state of six groups; write it with output mode complete or update."""
    df = spark.readStream.schema(schema).parquet(path)
    kept = df.filter(filters.shipped_by())
    return aggregates.finished(kept.groupBy(*KEYS).agg(*aggregates.fixed_point_sums(kept)))
