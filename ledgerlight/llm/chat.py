"""Chat formatting with cumulative-snapshot collapse.

A logged conversation that is a prefix of a longer one is an earlier snapshot of it. Every turn gets the rolling
hash of all turns up to it: sums of hashes that hold the turn's place, so a prefix sum over turns gives all prefixes.
A conversation whose last hash is an inner prefix of another is dropped by an anti-join, equal ones are one, and
the maximal conversations are rendered. DataFrame operations only.

Turns are numbered and summed in blocks of turn numbers, and the blocks' totals are added up afterwards, so a very long
conversation is not one task's work until it is rendered, as one string, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.workspace import written

#: Turn numbers to a block.
BLOCK = 256
#: Stands for a missing conversation id.
NO_ID = (1 << 63) - 1
#: The template of a turn.
BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT, NO_ROLE = "<|", "|>\n", "\n<|end|>\n", "unknown"
_PIECES = ("p1", "p2", "p3", "p4")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEFORE_ROLE), F.coalesce(role, F.lit(NO_ROLE)), F.lit(AFTER_ROLE), F.coalesce(text, F.lit("")), F.lit(AFTER_TEXT))


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _upto(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds what the earlier blocks of the same conversation sum up to."""
    ahead = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy("c", "block").agg(*(x.alias(f"_{k}") for k, x in sums.items()))
    base = per.select("c", "block", *(F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"base_{k}") for k in sums))
    return df.join(base, ["c", "block"])


def prefixes(turns: DataFrame) -> DataFrame:
    """c, rank, n_turns and the four pieces of the rolling hash for each turn."""
    order = Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = _upto(turns, {"n": F.count(F.lit(1))}).withColumn("rank", F.col("base_n") + F.row_number().over(order))
    a, b = F.xxhash64("rank", "h1", "h2"), F.xxhash64("h2", "rank", "h1")
    low = F.lit(0xFFFFFFFF).cast("bigint")
    pieces = {"p1": a.bitwiseAND(low), "p2": F.shiftrightunsigned(a, 32), "p3": b.bitwiseAND(low), "p4": F.shiftrightunsigned(b, 32)}
    pieced = written(numbered.select("c", "turn", "block", "h1", "h2", "rank", *(x.alias(k) for k, x in pieces.items())), "chat-turns")
    summed = _upto(pieced, {k: F.sum(k) for k in _PIECES})
    out = summed.select("c", "rank", *((F.col(f"base_{k}") + F.sum(k).over(inside)).alias(k) for k in _PIECES))
    length = pieced.groupBy("c").agg(F.max("rank").alias("n_turns"))
    return out.join(length, "c")


def collapse(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """c, n_turns, copies of the maximal conversations; c is conv_id, or NO_ID where that is missing."""
    turn = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("bigint")
    turns = conversations.select(F.coalesce("conv_id", F.lit(NO_ID)).cast("bigint").alias("c"), "turn", turn.alias("block"), _turn_hash(1).alias("h1"), _turn_hash(2).alias("h2"))
    every = written(prefixes(turns), "chat-prefixes")
    key = ["rank", *_PIECES]
    whole = every.filter(F.col("rank") == F.col("n_turns")).select("c", *key)
    inner = every.filter(F.col("rank") < F.col("n_turns")).select(*key).distinct()
    return whole.join(inner, key, "left_anti").groupBy(*key).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("copies")).select("c", F.col("rank").alias("n_turns"), "copies")


def formatted(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text of the maximal conversations of conversations (conv_id, turn, role, text; more
    columns are left out). copies: equal conversations, of which the least conv_id is kept. Turns stand in
    the order of turn, nulls first, ties by a hash of role and text. Null text: an empty turn; null role:
    unknown. Rows without conv_id are one conversation, with a null id. Repeated rows are turns like any other.
    Empty table: no rows. Prefixes are told by 128-bit hashes."""
    kept = written(collapse(spark, conversations), "chat-kept")
    turns = conversations.withColumn("c", F.coalesce("conv_id", F.lit(NO_ID)).cast("bigint")).select("c", F.struct("turn", _turn_hash(1).alias("h1"), _turn_hash(2).alias("h2"), rendered(F.col("role"), F.col("text")).alias("said")).alias("t"))
    joined = turns.join(kept.select("c"), "c", "left_semi").groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # structs sort with null turns last; they come first here
    first, rest = F.filter("ts", lambda t: t["turn"].isNull()), F.filter("ts", lambda t: t["turn"].isNotNull())
    text = F.array_join(F.transform(F.concat(first, rest), lambda t: t["said"]), "")
    return joined.select("c", text.alias("text")).join(kept, "c").select(F.when(F.col("c") != NO_ID, F.col("c")).alias("conv_id"), "n_turns", "copies", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = """
WITH t AS (SELECT conv_id, turn, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS said,
  md5(coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-')) AS h FROM conversations),
p AS (SELECT conv_id, row_number() OVER w AS rank, string_agg(h, '') OVER w AS pre FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT conv_id, max(rank) AS n_turns, arg_max(pre, rank) AS pre FROM p GROUP BY conv_id),
inner_ AS (SELECT DISTINCT p.pre FROM p JOIN f ON p.conv_id = f.conv_id AND p.rank < f.n_turns),
k AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies FROM f WHERE pre NOT IN (SELECT pre FROM inner_) GROUP BY pre, n_turns)
SELECT k.conv_id, k.n_turns, k.copies, string_agg(t.said, '' ORDER BY t.turn) AS text FROM k JOIN t ON k.conv_id = t.conv_id GROUP BY k.conv_id, k.n_turns, k.copies
"""
