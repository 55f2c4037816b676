import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from cases import frame, odd_docs
from pyspark.sql import functions as F

from ledgerlight.llm import minhash
from ledgerlight.llm import words as W
from ledgerlight.llm.components import components


def bag(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def alike(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(texts, at=0.8):
    """Class of each text: least index."""
    texts = [t or "" for t in texts]
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (bags[i] and bags[j] and alike(bags[i], bags[j]) >= at):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def partition(pairs):
    out = defaultdict(set)
    for x, c in pairs:
        out[c].add(x)
    return sorted(map(sorted, out.values()))


def chain(rnd):
    """Texts of which each is like the next one only, and a bucket's worth of mutual near misses around one hub."""
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    out, x = [], base
    for i in range(12):
        out.append(" ".join(x))
        x = x[:]
        for j in range(2 + i % 3):
            x[(i * 29 + j * 7) % 300] = f"n{i}-{j}"
    hub = [f"h{rnd.randrange(10**6)}" for _ in range(400)]
    out.append(" ".join(hub))
    for i in range(40):
        x = hub[:]
        for j in range(8):
            x[rnd.randrange(400)] = f"s{i}-{j}"
        out.append(" ".join(x))
    return out


def run(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = frame(spark, rows).withColumn("th", F.lit("clash")).withColumn("band", F.lit(1))
    return minhash.classes(spark, docs).collect()


def test_classes(spark):
    texts = [r[1] for r in odd_docs()] + chain(random.Random(3))
    got = run(spark, texts)
    assert len(got) == len(texts)
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(brute(texts)))
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got)


def test_groups_that_no_task_may_hold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEADERS", 1)
    monkeypatch.setattr(minhash, "GROUP_TEXTS", 3)
    texts = chain(random.Random(5))
    assert {r.doc_id: r.class_id for r in run(spark, texts)} == dict(enumerate(brute(texts)))


def test_recall_by_length(spark):
    """Pairs with changed words, at similarity 0.8 to 0.9 of their shingles, by brute force: found, at every length."""
    rnd, texts, due = random.Random(8), [], []
    for n in (40, 60, 100, 300, 1000):
        for _ in range(30):
            while True:
                a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
                b = a[:]
                for _ in range(rnd.randrange(1, max(2, n // 25))):
                    b[rnd.choice([0, 1, n - 1, rnd.randrange(n)])] = f"c{rnd.randrange(10**6)}"
                if 0.8 <= alike(bag(" ".join(a)), bag(" ".join(b))) < 0.9:
                    break
            due.append((n, len(texts)))
            texts += [" ".join(a), " ".join(b)]
    got = {r.doc_id: r.class_id for r in run(spark, texts)}
    for n in (40, 60, 100, 300, 1000):
        found = [got[i + 1] == i for m, i in due if m == n]
        assert sum(found) >= 0.97 * len(found), (n, sum(found))


def test_ties_are_stable(spark):
    rows = [(1, "a b c d e f g", x, "s", 0) for x in ("fr", "en", "de")] * 2 + [(2, "other", None, None, None)]
    got = {tuple(sorted(map(str, minhash.deduplicated(spark, frame(spark, rows).repartition(n)).collect()))) for n in (1, 2, 3, 5)}
    assert len(got) == 1 and len(next(iter(got))) == 2


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: r.class_id for r in minhash.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: docs[c].doc_id for d, c in zip(docs, brute([d.text for d in docs]), strict=True)}


def test_signature_estimates_similarity():
    rnd = random.Random(1)
    a = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(400))
    b = " ".join(x if rnd.random() > 0.04 else "zz" for x in a.split(" "))
    data = (a + b).encode()
    sig, _ = minhash.signatures(W.Words(np.frombuffer(data, np.uint8), np.array([0, len(a.encode()), len(data)])), 4096)
    assert abs((sig[0] == sig[1]).mean() - alike(bag(a), bag(b))) < 0.03
    short = W.Words(np.frombuffer(b"a b ca b c", np.uint8), np.array([0, 5, 10]))
    sig, weight = minhash.signatures(short, 150)
    assert (sig[0] == sig[1]).all() and list(weight) == [1, 1]


def test_missing_ids_and_empty(spark):
    rows = [(None, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (4, "a b c d e f", None, None, None), (4, "a b c d e f", None, None, None), (None, "other", None, None, None)]
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in minhash.classes(spark, frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 4, 4), (None, 4, 4), (4, 4, 4), (4, 4, 4), (None, None, 1)], key=repr)
    assert minhash.classes(spark, frame(spark, [])).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + rnd.randrange(1, 300)) for _ in range(300)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert set(got.values()) == {0, 1000, 6000} and got[200] == 0 and got[6001] == 6000 and 5000 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketches_lose_less_than_bands():
    """At the least similarity, by the binomial distribution; and a pair that agrees in 0.72 of the coordinates is met."""
    n, s = minhash.BANDS * minhash.BAND_ROWS, minhash.SIMILARITY
    least = math.ceil((s - minhash.MARGIN) * n - 1e-9)
    lost = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(least))
    assert lost < (1 - s**minhash.BAND_ROWS) ** minhash.BANDS / 5
    a = (np.arange(n) % 200).astype(np.uint8)
    b = np.where(np.arange(n) < 0.72 * n, a, a + 1).astype(np.uint8)
    cols = {"part": [1, 1], "block": [0, 0], "leads": [True, False], "th": [5, 6], "root": [5, 6], "upper": [True, True], "band": [0, 0]}
    rows = pa.table(cols | {"sketch": pa.array([a.tobytes(), b.tobytes()])})
    assert minhash._likely(s - minhash.MARGIN, minhash.BAND_ROWS)(rows).to_pylist() == [{"a": 5, "b": 6}]
