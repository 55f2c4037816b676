"""Mixing sources to target weights.

Every document gets a hash-random key; each source is cut where the running sum of its sizes, in key order,
reaches its budget, after as many whole repeats (epochs) as the budget holds. The prefix sum is distributed: keys
are uniform, so equal ranges of keys (buckets) are even even in a hot source; sums of buckets are added up
source by source, and only the one bucket that holds a source's cut is ordered row by row; a source of n rows has
the root of n buckets, so neither list is long. What is decided
is a cut row for each source, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.workspace import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
KEY_BITS = 60


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def key_of(doc_id: Column, seed: str = SEED) -> Column:
    """60 hash bits of the id; the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source: sid, source, source_size, n, target. Sources by code point, null last, weigh
    weights[0], weights[1], ... repeating. Targets share the sum of sizes by weight, stop at cap times their
    source's size, and what is over is shared again by weight until none is above: water filling, solved in
    one pass in the order of size by weight. sizes has one row a source: the mixture's configuration, not data."""
    every, filled = Window.partitionBy(), Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    big = "decimal(38,0)"
    x = sizes.withColumn("sid", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    x = x.withColumn("ratio", F.col("source_size") / F.col("weight")).withColumn("total", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    x = x.withColumn("words_left", F.col("total") - cap * F.coalesce(F.sum("source_size").over(filled), F.lit(0))).withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    x = x.withColumn("full", (F.lit(cap) * F.col("source_size")).cast(big) * F.col("weight_left").cast("decimal(18,0)") <= F.col("words_left").cast(big) * F.col("weight").cast("decimal(18,0)"))
    rest_words = F.max("total").over(every) - F.sum(F.when(F.col("full"), cap * F.col("source_size")).otherwise(0)).over(every)
    rest_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("weight") * rest_words).cast("double") / rest_weight.cast("double"))
    return x.select("sid", "source", "source_size", "n", target.alias("target"))


def cuts(spark: SparkSession, keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source: its target, epochs, and the row at which the last, partial epoch is cut: cut_key,
    cut_id, cut_size; cut_words words fall to the cut_rows rows that are equal to it (one, unless rows repeat).
    keyed: doc_id, source, size, key."""
    per = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = written(targets(per, weights, cap).withColumn("epochs", epochs).withColumn("rest", goal - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.sqrt("n")).cast("bigint")), "mix-plan")
    bucket = F.shiftright(F.shiftright("key", KEY_BITS - 40) * F.col("buckets"), 40)
    rows = keyed.join(plan.select("sid", "source", "buckets", "rest"), keyed.source.eqNullSafe(plan.source)).drop(plan.source).withColumn("bucket", bucket)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    cut_in = sums.withColumn("upto", upto).filter("upto > rest AND upto - words <= rest").select("sid", "bucket", (F.col("upto") - F.col("words")).alias("base"))
    near = rows.join(cut_in, ["sid", "bucket"]).groupBy("sid", "key", "doc_id", "size", "rest", "base").agg(F.count(F.lit(1)).alias("same"))
    line = Window.partitionBy("sid").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum(F.col("size") * F.col("same")).over(line)
    cut = near.withColumn("end", end).withColumn("begin", F.col("end") - F.col("size") * F.col("same")).filter("end > rest AND begin <= rest")
    cut = cut.select("sid", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), (F.col("rest") - F.col("begin")).alias("cut_words"), F.col("same").alias("cut_rows"))
    return written(plan.join(cut, "sid", "left"), "mix-cuts")


def taken(whole: bool) -> Column:
    """Words that the mix takes of a row, repeats counted. whole: the row at the cut goes in whole if half of
    it fits, and else not at all; otherwise with as many words as are left."""
    no_id, no_cut = F.col("doc_id").isNull(), F.col("cut_id").isNull()
    id_before = (no_id & ~no_cut) | (~no_id & ~no_cut & (F.col("doc_id") < F.col("cut_id")))
    same_id = F.col("doc_id").eqNullSafe(F.col("cut_id"))
    before = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (id_before | (same_id & (F.col("size") < F.col("cut_size")))))
    at = (F.col("key") == F.col("cut_key")) & same_id & (F.col("size") == F.col("cut_size"))
    part = F.when(2 * F.col("cut_words") >= F.col("size") * F.col("cut_rows"), F.col("size")).otherwise(0) if whole else F.floor(F.col("cut_words") / F.col("cut_rows"))
    last = F.when(F.col("cut_key").isNull(), 0).when(before, F.col("size")).when(at, part).otherwise(0)
    return (F.col("epochs") * F.col("size") + last).cast("bigint")


def mix(spark: SparkSession, docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source; more columns are
    left out). Null text: size 0; a very long one is counted whole. Null source: a source of its own, last. Null and repeated ids: rows like any
    other; fully equal rows at a cut share its words evenly. Empty table: no rows."""
    keyed = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key")), "mix-keys")
    plan = cuts(spark, keyed, weights, cap)
    rows = keyed.join(plan.withColumnRenamed("source", "plan_source"), keyed.source.eqNullSafe(F.col("plan_source")))
    return rows.select("doc_id", "size", "source_size", "target", taken(whole=False).alias("taken"), "source", "epochs")


def mixed(spark: SparkSession, docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixture itself: rows of docs with their columns, whatever they are called, each as often as it is taken;
    documents stay whole. A row without words, null texts among them, can't be weighed and is taken once in each
    whole epoch, or once if there is none. Null source: a source of its own, last. Null and repeated ids: rows like any other; fully equal
    rows at a cut go in together or not at all. Empty table: no rows."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("source").alias("own_source"), size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key"))
    keyed = written(sized.select("doc_id", F.col("own_source").alias("source"), "size", "key"), "mix-keys")
    plan = cuts(spark, keyed, weights, cap)
    rows = sized.join(plan, F.col("own_source").eqNullSafe(F.col("source")))
    copies = F.when(F.col("size") > 0, F.floor(taken(whole=True) / F.greatest(F.col("size"), F.lit(1)))).otherwise(F.greatest(F.col("epochs"), F.lit(1))).cast("int")
    return rows.withColumn("copies", copies).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("source", "epochs")


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
  coalesce(sum(source_size) OVER f, 0) AS s_before, coalesce(sum(weight) OVER f, 0) AS w_before FROM w
  WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * (all_weight - w_before) <= (total - 3 * s_before) * weight AS filled FROM r),
t AS (SELECT sid, source, source_size, CASE WHEN filled THEN CAST(3 * source_size AS DOUBLE)
  ELSE CAST(weight * (total - coalesce(sum(3 * source_size) FILTER (WHERE filled) OVER (), 0)) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE NOT filled) OVER () AS DOUBLE) END AS target FROM c),
e AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // CAST(source_size AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, epochs, goal - epochs * CAST(source_size AS BIGINT) AS rest,
  CAST(sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(rest - ahead, 0), size) AS BIGINT) AS taken FROM p
"""
