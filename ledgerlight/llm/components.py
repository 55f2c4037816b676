"""Connected components of links, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.workspace import dropped, written

ROUNDS = 60


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """links: a, b, of one orderable type, in either direction, repeats and loops allowed. Returns node, root for
    every node that has a link: root is the least node of its component.

    Alternating large-star and small-star rounds: each node tells its neighbours the least node it sees.
    Minima are combined before the shuffle, so a node with very many links sends one row a task, and the joins
    that follow are plain equi-joins that AQE splits where a node is hot. Rounds grow with the logarithm of
    the longest path, and end when no node is both above and below another. Each round's links are a written table,
    and the round before goes."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges, name)
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        before, edges = edges, written(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), name)
        dropped(before)
        if edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
