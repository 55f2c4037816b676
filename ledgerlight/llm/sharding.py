"""Contiguous, balanced shards.

Rows are range-partitioned by id; each task adds up the bytes of its own, sorted partition; the totals of
the partitions, one row each, give every partition its place in the global prefix sum; cuts at equal targets
make contiguous shards. To number the rows, only ids, sizes and checksums are shuffled; to write shards, whole rows, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.workspace import unused, written

SHARDS = 8


def _running(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the bytes and rows that come before each row in its partition."""
    part, done_bytes, done_rows = TaskContext.get().partitionId(), 0, 0
    for b in parts:
        sizes = b.column("size").to_numpy()
        upto = np.cumsum(sizes) + done_bytes
        more = [pa.array(np.full(len(sizes), part, np.int64)), pa.array(upto - sizes), pa.array(np.arange(len(sizes), dtype=np.int64) + done_rows)]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "part", "bytes_before", "rows_before"])
        if len(sizes):
            done_bytes, done_rows = int(upto[-1]), done_rows + len(sizes)


def _cut(ranged: DataFrame, shards: int) -> DataFrame:
    """Adds shard and slot to rows that stand in their order in sorted partitions: size and more columns."""
    fields = [*ranged.schema.fields, *(T.StructField(c, T.LongType()) for c in ("part", "bytes_before", "rows_before"))]
    rows = written(ranged.mapInArrow(_running, T.StructType(fields)), "shard-sums")
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    zero = F.lit(0).cast("bigint")
    place = totals.select("part", F.coalesce(F.sum("part_bytes").over(ahead), zero).alias("base_bytes"), F.coalesce(F.sum("part_rows").over(ahead), zero).alias("base_rows"), F.sum("part_bytes").over(Window.partitionBy()).alias("total"))
    middle = (2 * (F.col("base_bytes") + F.col("bytes_before")) + F.col("size")).cast("decimal(30,0)")
    number = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / (2 * F.col("total")).cast("decimal(30,0)")).cast("int"))
    placed = rows.join(F.broadcast(place), "part").select(*ranged.columns, number.alias("shard"), (F.col("base_rows") + F.col("rows_before")).alias("place"))
    begins = placed.groupBy("shard").agg(F.min("place").alias("begin"))
    out = placed.join(F.broadcast(begins), "shard")  # as many rows as shards
    return out.select(*ranged.columns, "shard", (F.col("place") - F.col("begin")).alias("slot"))


def _sized(text: Column) -> tuple[Column, Column]:
    data = F.coalesce(text, F.lit("")).cast("binary")
    return (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text; more columns are left
    out). Size is the text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of the empty text. Rows stand in
    the order of doc_id, nulls first, then checksum, size; a row belongs to the shard in which its middle byte
    falls, so sizes differ from the target by a document at most, a very long one too. Repeated rows are rows like any
    other. Empty table: no rows. Fewer bytes than shards: some shards are empty. slot counts a shard's rows from 0."""
    base = written(docs.select("doc_id", *_sized(F.col("text"))), "shard-sizes")
    out = _cut(base.repartitionByRange(*_order()).sortWithinPartitions(*_order()), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of docs with its columns, after the columns of shard(), by the same law. A column of docs that is called like
    one of those gets underscores before its name. Ids may be missing or repeat, and rows may repeat: each
    physical row has one shard and one slot. For this the rows travel whole, once, to their range."""
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    others = [c for c in docs.columns if c != "doc_id"]
    base = docs.select(F.struct(*others).alias("row"), "doc_id", *_sized(F.col("text")))
    out = _cut(base.repartitionByRange(*_order()).sortWithinPartitions(*_order()), shards)
    carried, taken = [], ["doc_id", *names]
    for c in others:
        carried.append(F.col("row")[c].alias(new := unused(c, taken, [x for x in others if x != c])) if c.lower() in {x.lower() for x in names} else F.col("row")[c].alias(new := c))
        taken.append(new)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *carried)


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Writes the rows of sharded(docs) as Parquet, a folder for each shard, and returns them as read back."""
    sharded(spark, docs, shards).write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
