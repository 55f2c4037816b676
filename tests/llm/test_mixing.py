import re
from collections import defaultdict

from cases import frame, odd_docs
from compare import check_query
from pyspark.sql import functions as F

from ledgerlight.llm import mixing


def test_against_sql(spark):
    assert len(check_query(spark, "/root/testdata/sf0.01", mixing.query, mixing.SQL)) == 1000


def goals(sizes):
    """Water filling, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_odd_rows(spark):
    rows = odd_docs()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, took = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = goals(sizes)
    got = mixing.mix(spark, frame(spark, rows).withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(size(r[1]) for r in rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= 2
    again = mixing.mix(spark, frame(spark, rows[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_whole_documents(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "s", i) for i in range(500)] + [(500 + i, "w " * 5, "en", "t", i) for i in range(20)]
    docs = frame(spark, rows).withColumn("copies", F.lit(9)).withColumn("row", F.lit("clash"))
    out = mixing.mixed(spark, docs)
    assert out.columns == docs.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    plan = goals({"s": sum(1 + i % 7 for i in range(500)), "t": 100})
    assert all(abs(words[s] - plan[s]) <= 7 for s in plan)


def test_empty(spark):
    assert mixing.mix(spark, frame(spark, [])).count() == mixing.mixed(spark, frame(spark, [])).count() == 0
