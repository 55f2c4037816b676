import math
import random
import re
from zlib import crc32

import numpy as np
from cases import frame, odd_docs
from pyspark.sql import functions as F

from ledgerlight.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.query(spark, path).collect()}
    labels = [r for r in spark.read.parquet(f"{path}/labels.parquet").collect() if got[r.doc_id].held_out]
    pred, true = np.array([got[r.doc_id].predicted for r in labels]), np.array([r.toxic for r in labels])
    assert len(labels) > 500
    assert (pred[true == 1]).mean() > 0.85 and (pred[true == 0]).mean() < 0.02
    assert all((r.score >= 0.3) == bool(r.predicted) for r in got.values())


def test_odd_rows(spark):
    docs = frame(spark, odd_docs()).withColumn("score", F.lit("clash")).withColumn("y", F.lit(3))
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (None, 1, 1), (4, 1, None), (6, 0, 0), (99999, 0, 1)], LABELS)
    out = toxicity.scored(spark, docs, labels)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_without_labels(spark):
    rows = [(1, "you are a stupid, worthless idiot and a moron", "en", "a", 0), (2, "the weather is fine", "en", "a", 0), (3, None, "en", "a", 0)]
    labels = spark.createDataFrame([], LABELS)
    got = {r.doc_id: r.score for r in toxicity.scored(spark, frame(spark, rows), labels).collect()}
    assert got[1] > 0.9 > 0.3 > got[2] >= got[3]
    assert toxicity.scored(spark, frame(spark, []), labels).count() == 0


def test_label_model_finds_hidden_rates(spark):
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    fires, misfires = np.array([0.5, 0.4, 0.3, 0.3, 0.3]), np.array([0.01, 0.02, 0.01, 0.05, 0.05])
    x = rng.random((6000, 5)) < np.where(y[:, None], fires, misfires)
    x[:, 4] = x[:, 3]  # one voter twice
    votes = spark.createDataFrame([(int(v), 1) for v in (x * (1 << np.arange(5))).sum(1)], "votes bigint, n bigint")
    seen = np.arange(400)
    m = toxicity.label_model(votes, x[seen], y[seen].astype(int), 0.2, 5)
    assert np.abs(m.fires - fires).max() < 0.15 and np.abs(m.misfires - misfires).max() < 0.05
    assert m.part[4] < 0.6 < m.part[0]


def test_vocabulary_and_scores_against_counting(spark):
    rnd = random.Random(4)
    mild = [f"{a}{b}{c}" for a in ("lan", "mor", "tes", "vil") for b in ("do", "ra", "ni") for c in ("k", "m", "st")]
    rude = ["grumbler", "grumbling", "grumbled", "snarkful", "snarkier", "blightor"]
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        own = rnd.choices(mild, k=rnd.randrange(3, 30)) + (rnd.choices(rude, k=rnd.randrange(1, 5)) if bad or rnd.random() < 0.05 else [])
        rnd.shuffle(own)
        rows.append((k, rnd.choice([" ", ", ", " 12 "]).join(own).title(), "en", "s", 0))
        if k < 320:
            labels.append((k, 1, int(bad)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "mild " * 50_000 + " grumbling grumbler blightor", "en", "s", 0)]
    docs, given = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(spark, docs, given)

    words = {k: {w for w in re.split("[^a-z]+", (t or "").lower()) if w} for k, t, *_ in rows}

    def there(f, ws):
        if f[0] == "=":
            return f[1:] in ws
        begin, _, t = f.partition("*")
        return sum(w.startswith(begin) for w in ws) >= int(t or 1)

    learned = [(words[k], y) for k, _, y in labels if crc32(str(k).encode()) % 4 != 2]
    n = [sum(y == v for _, y in learned) for v in (0, 1)]
    every = {w for ws, _ in learned for w in ws}
    tried = {f"={w}" for w in every} | {f"{w[:k]}*{t}" for w in every for k in range(4, 9) if len(w) >= k for t in ("", 2, 3, 5)}
    mined = set()
    for f in tried:
        on = [sum(there(f, ws) for ws, y in learned if y == v) for v in (0, 1)]
        g2 = 0
        for v in (0, 1):
            for seen, row in ((on[v], sum(on)), (n[v] - on[v], sum(n) - sum(on))):
                g2 += 2 * seen * math.log(seen * sum(n) / (n[v] * row)) if seen else 0
        if on[1] * n[0] > on[0] * n[1] and g2 >= 15:
            mined.add(f)
    assert len(mined) > 5 and set(model.vocabulary) == mined | {f"={w}" for w in toxicity.LEXICON}

    got = {r.doc_id: r.score for r in toxicity.scored(spark, docs, given).collect()}
    for k, ws in words.items():
        z = model.weights[-1] + sum(w for f, w in zip(model.vocabulary, model.weights, strict=False) if there(f, ws))
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9
    assert got[1002] > 0.9 and got[1000] == got[1001] < 0.3
