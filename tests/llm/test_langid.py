import numpy as np
import pyarrow as pa
from cases import frame, odd_docs
from pyspark.sql import functions as F

from ledgerlight.llm import langid


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.query(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    held = [d for d in docs if got[d.doc_id].held_out]
    assert 100 < len(held) < 300
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    docs = frame(spark, odd_docs() + [(900, "12 34 !!", "en", "a", 0), (901, "日本語", None, "a", 0), (902, "q", None, "a", 0)]).withColumn("score", F.lit("clash")).withColumn("k", F.lit(1))
    got = langid.identify(spark, docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 5, 900))
    assert by[901].lang_pred != "und" and by[902].lang_pred != "und"
    assert not [r for r in got if r.doc_id is None and r.held_out]


def test_nothing_to_learn(spark):
    rows = [(1, "some text", None, "a", 0)]
    assert [r.lang_pred for r in langid.identify(spark, frame(spark, rows)).collect()] == ["und"]
    assert langid.identify(spark, frame(spark, [])).count() == 0


def test_filters_hold_what_they_were_given():
    rng = np.random.default_rng(1)
    grams = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    masks = (np.uint64(1) << rng.integers(0, 4, 20_000).astype(np.uint64))
    f = langid.Filters(list("abcd"), grams, masks, 0)
    assert ((f.holding(grams) & masks) == masks).all()
    other = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    for k in range(4):
        assert abs(((f.holding(other) >> np.uint64(k)) & np.uint64(1)).mean() - f.chance[k]) < 0.01


def test_grams_stay_inside_texts():
    seen = {}
    for i, j, x, first in langid.grams(pa.array(["Ab", None, "", "ab", "abc"])):
        for d in range(i, j):
            seen[d] = [v for v in x[first[d - i] : first[d - i + 1]].tolist() if v]
    assert seen[0] == seen[3] and not seen[1] and not seen[2] and len(seen[0]) == 3 + 2 and len(seen[4]) == 6


def test_more_languages_than_bits(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(130):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rng.choice(words, 15)), f"l{k:03}", "a", 0) for i in range(12 if k < 70 else 11)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark, frame(spark, rows)).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_filters_of_several_words():
    rng = np.random.default_rng(2)
    grams = rng.integers(1, 1 << 63, 5000).astype(np.uint64)
    k = rng.integers(0, 150, 5000)
    masks = np.zeros((5000, 3), np.uint64)
    masks[np.arange(5000), k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
    f = langid.Filters([str(i) for i in range(150)], grams, masks, 0)
    assert ((f.holding(grams) & masks) == masks).all()
    mine = [149, 64, 63, 0]
    x = np.concatenate([grams[k == m] for m in mine])
    first = np.cumsum([0, *(int((k == m).sum()) for m in mine)])
    assert f.shares(x, first).argmax(1).tolist() == mine


def test_shares_against_counting(spark):
    """Shares of the filters against sets of n-grams, without Bloom filters."""
    rng = np.random.default_rng(6)
    grams = np.unique(rng.integers(1, 1 << 63, 9000).astype(np.uint64))
    masks = rng.integers(1, 8, len(grams)).astype(np.uint64)
    f = langid.Filters(list("abc"), grams, masks, 0)
    held = [set(grams[(masks >> np.uint64(k)) & np.uint64(1) == 1].tolist()) for k in range(3)]
    texts = [rng.choice(grams, 400) if i % 2 else np.r_[rng.choice(grams, 200), rng.integers(1, 1 << 63, 200).astype(np.uint64)] for i in range(20)]
    shares = f.shares(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    for t, got in zip(texts, shares, strict=True):
        n = np.array([sum(x in h for x in t.tolist()) for h in held], float)
        assert np.abs(got - n / n.sum()).max() < 0.02


def test_counts_flushed(monkeypatch):
    b = pa.RecordBatch.from_arrays([pa.array(["en", "fr"] * 20), pa.array([f"text number {i} of some" for i in range(40)])], names=["lang", "text"])

    def counted():
        n = {}
        for r in langid._count(["en", "fr"])(iter([b, b])):
            for g, k, c in zip(*(x.to_pylist() for x in r.columns), strict=True):
                n[g, k] = n.get((g, k), 0) + c
        return n

    whole = counted()
    monkeypatch.setattr(langid, "HELD", 10)
    assert counted() == whole and len(whole) > 40
