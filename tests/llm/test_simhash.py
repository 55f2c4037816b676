import hashlib
import random

import numpy as np
import pytest
from cases import frame, odd_docs, saved
from pyspark.sql import functions as F

from ledgerlight.llm import simhash
from ledgerlight.llm import words as W


def check(got, rows, order):
    rows = sorted(rows, key=order)
    want = []
    for k, r in enumerate(rows):
        text, after = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        new = simhash.edited(text, after)
        a, b, c = simhash.fingerprints([text.encode(), new.encode(), after.encode()])
        want.append((r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float(simhash.likeness(a, b)), float(simhash.likeness(a, c))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def hashes(spark, rows):
    df = frame(spark, rows).select(F.xxhash64("text").alias("h")).collect()
    return {r[1]: h.h for r, h in zip(rows, df, strict=True)}


@pytest.mark.parametrize("chunk", [1 << 18, 2000])
def test_odd_rows(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = odd_docs()
    h = hashes(spark, rows)
    docs = frame(spark, rows).withColumn("part", F.lit("clash")).withColumn("kind", F.lit("row")).repartition(5)
    got = simhash.fingerprinted(spark, docs).collect()
    # fully equal rows are interchangeable; null and empty text hash differently, and order by that hash
    check(got, rows, lambda r: (r[0] is None, r[0] or 0, h[r[1]]))


def test_documents(spark):
    path = "/root/testdata/sf0.001"
    got = simhash.query(spark, path).drop("n_within").collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    check(got, rows, lambda r: r[0])
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def test_votes_by_hand():
    """A small text against sums of signed bits, term by term."""
    text = b"a b a b c"
    h, _, _ = W.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).windows(2)
    n = {int(x): (h == x).sum() for x in h}
    votes = np.zeros(128)
    for x, k in n.items():
        both = np.array([x, int(W.mix(np.array([x], W.U) + simhash._SALT)[0])], W.U)
        votes += np.rint(16 * (1 + np.log(k))) * np.where(np.unpackbits(both.view(np.uint8)) == 1, 1, -1)
    assert (np.packbits(votes > 0) == simhash.fingerprints([text])[0]).all()


@pytest.mark.parametrize(("radius", "match"), [(5, 2), (3, 1)])
def test_search_is_complete(spark, radius, match):
    rnd = random.Random(4)
    base = [rnd.getrandbits(128) for _ in range(20)]
    marks = {b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randrange(0, 9))) for b in base for _ in range(20)}
    hexed = [f"{m:032x}" for m in marks] + [None]
    df = spark.createDataFrame([(m,) for m in hexed], "f string")
    some = df.limit(50)
    got = {(r.query, r.fingerprint): r.distance for r in simhash.within(df, some, radius, match).collect()}
    asked = [r.f for r in some.collect() if r.f]
    want = {(q, m): (int(q, 16) ^ int(m, 16)).bit_count() for q in asked for m in hexed if m and (int(q, 16) ^ int(m, 16)).bit_count() <= radius}
    assert got == want


def test_one_and_none(spark):
    (r,) = simhash.fingerprinted(spark, frame(spark, [(1, "abcd efgh", None, None, None)])).collect()
    assert r.near_next == 1.0 and r.n_chars == 9
    assert simhash.fingerprinted(spark, frame(spark, [])).count() == 0


def test_search_of_the_query(spark, tmp_path):
    """Each query row against all rows, by distance; some have near ones and copies, and some rows have no id."""
    rnd = random.Random(4)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(400)] for _ in range(4)]
    rows = []
    for i in range(220):
        w = list(base[i % 4]) if i % 3 else [f"v{rnd.randrange(10**6)}" for _ in range(50)]
        if i // 4 % 2:
            w[rnd.randrange(len(w))] = f"new{i}"
        rows.append((i if i % 11 else None, " ".join(w), "en", "s", 0))
    got = simhash.query(spark, saved(spark, tmp_path, rows)).collect()
    marks = [int(x, 16) for x in {r.fingerprint for r in got}]
    assert len(got) == len(rows)
    for r in got:
        asks = r.doc_id is not None and r.doc_id % 50 == 0
        assert r.n_within == (sum((int(r.fingerprint, 16) ^ m).bit_count() <= simhash.RADIUS for m in marks) if asks else None)
    assert max(r.n_within or 0 for r in got) > 1
