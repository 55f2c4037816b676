"""A corpus pipeline: documents to shards, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import decontam, minhash, mixing, sharding, toxicity
from ledgerlight.llm.workspace import unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold, with all their columns. Null and empty texts stay, very long ones are
    scored whole, repeated rows are judged alike. Without labels a lexicon decides. Empty table: no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    score = unused("score", docs.columns)
    return toxicity.scored(spark, docs, labels, score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, with all its columns: the one of least doc_id, missing ones last, then of least
    row hash. Null and empty texts are one class, a repeated row stays once. Empty table: no rows."""
    return minhash.deduplicated(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch of a benchmark item, with all their columns. Null and empty texts stay, very long ones are
    searched whole, repeated rows are judged alike. Empty benchmark: all stay. Empty table: no rows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    spans = unused("spans", docs.columns)
    return decontam.overlaps(spark, docs, benchmark, spans).filter(F.size(spans) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, with all their columns, as often as the mixture takes them, so ids may repeat from here on. Documents stay whole; those without
    words are taken once an epoch. Null source: a source of its own. Empty table: no rows."""
    return mixing.mixed(spark, docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there, and with its text and other columns, so that shards can be written as
    they are. Null and repeated ids and repeated rows have a shard and a slot each. Empty table: no rows."""
    return sharding.sharded(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: The classifier and the signatures can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
