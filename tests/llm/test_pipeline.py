from collections import Counter

import corpus_pipeline
from cases import frame, odd_docs
from pyspark.sql import functions as F
from test_decontam import words
from test_minhash import brute
from test_mixing import goals
from test_sharding import brute as shards

from ledgerlight.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    scores = {r.doc_id: r.predicted for r in toxicity.query(spark, SF).collect()}
    # how well it predicts is held against labels in test_toxicity, on a table that has enough of them
    assert rows(clean) == rows(docs.filter(~F.col("doc_id").isin([i for i, p in scores.items() if p])))

    single = corpus_pipeline.drop_near_copies(spark, docs, SF)
    ordered = docs.orderBy("doc_id").collect()
    kept = {ordered[c].doc_id for c in brute([d.text for d in ordered])}
    assert rows(single) == rows(docs.filter(F.col("doc_id").isin(list(kept))))

    free = corpus_pipeline.drop_contaminated(spark, docs, SF)
    items = [" ".join(words(i.text)) for i in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {d.doc_id for d in ordered if any(i in " ".join(words(d.text)) for i in items)}
    left = {r.doc_id for r in free.collect()}
    assert exact and not exact & left and len(left) >= 0.9 * (docs.count() - len(exact))

    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    sized = mixed.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    plain = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    longest = docs.agg(F.max(mixing.size_of(F.col("text")))).first()[0]
    want = goals(plain)
    assert all(abs(r.n - want[r.source]) <= longest for r in sized)
    assert all(x.columns == docs.columns for x in (clean, single, free, mixed))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = Counter(map(tuple, out.select(*names).collect()))
    assert got == Counter(shards([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert {s for *_, s, _, _ in got} == set(range(8))
    assert rows(out.select(*docs.columns)) == rows(docs)  # a written shard set holds the mixed rows


def test_odd_rows(spark, tmp_path):
    """Columns with names that stages use themselves come back with their values."""
    docs = frame(spark, odd_docs())
    clashing = ["score", "spans", "row", "shard", "slot", "size", "key", "__size", "__key", "copies", "epochs", "th", "own"]
    for c in clashing:
        docs = docs.withColumn(c, F.lit(f"clash {c}"))
    spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        x = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            x = stage(spark, x, str(tmp_path))
            assert x.columns == docs.columns
            assert all(r[c] == f"clash {c}" for r in x.select(*clashing).collect() for c in clashing)
        last = corpus_pipeline.STAGES[-1][1](spark, x, str(tmp_path))
        assert last.count() == x.count()
        assert all((r._shard, r._slot, r._size) == ("clash shard", "clash slot", "clash size") for r in last.collect())
