"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session sets it; else, with a local master as in tests, a folder of this process.
    A cluster without that setting is refused: executors would write to disks that no other one reads."""
    if set_by_cluster := spark.conf.get("spark.checkpoint.dir", None):
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="ledgerlight-")
    return _own[context.applicationId]


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """df as a table that outlives its executors: later reads don't compute it again and don't depend on
    shuffle files. It stays until it is dropped or the shared folder is cleaned. parts: columns by which it is in folders."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the execution that made them, as tables are written here and read again; else they stay until the driver
    happens to collect its garbage. Only disk depends on it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropped(df: DataFrame, part: str = "") -> None:
    """Deletes a table that written() returned, or a part of it, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{df.written_to}/{part}" if part else df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *taken: list[str]) -> str:
    """name, or name with underscores before it, so that no column is called so, in upper or lower case."""
    own = {c.lower() for columns in taken for c in columns}
    while name.lower() in own:
        name = f"_{name}"
    return name
