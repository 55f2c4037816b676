import random

import numpy as np
import pytest
from cases import frame, odd_docs
from pyspark.sql import functions as F

from ledgerlight.llm import decontam
from ledgerlight.llm import words as W

ITEMS = "item_id bigint, text string"


def vocabulary(n=4000):
    rnd = random.Random(11)
    return rnd, ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def brute(doc, item):
    """Most equal words of a stretch, over all alignments of the two texts; the best stretch by the same weights."""
    d, i = words(doc or ""), words(item or "")
    best = 0
    for shift in range(-len(i) + 1, len(d)):
        lo, hi = max(0, shift), min(len(d), shift + len(i))
        same = np.array([d[k] == i[k - shift] for k in range(lo, hi)], bool)
        best = max(best, decontam.stretch(same)[2])
    return bool(i) and best >= min(decontam.MIN_WORDS, len(i))


def planted():
    rnd, vocab = vocabulary()
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(rnd.randrange(16, 60)))) for k in range(40)] + [(100, "Tiny item, four!"), (101, None), (102, ""), (103, "..."), (104, "x")]
    rows = []
    for k in range(40):
        w = items[k][1].split()
        if k % 4 == 1:  # every eighth word changed
            w = [x if j % 8 else "changed" for j, x in enumerate(w)]
        if k % 4 == 2:
            w = w[: len(w) // 2]
        body = " ".join([*text(50), *w, *text(50)])
        rows.append((k, body.upper() if k % 3 else body.replace(" ", ",  "), "en", "s", 0))
    rows += [(1000 + k, " ".join(text(200)), "en", "s", 0) for k in range(40)]
    rows += [(2000, "a tiny ITEM four b", "en", "s", 0), (2001, "tiny item", "en", "s", 0), (2002, "x", "en", "s", 0)]
    return items, rows


def test_against_alignments(spark):
    items, rows = planted()
    rows += [(5000 + k, *r[1:]) for k, r in enumerate(odd_docs()[:2])]
    docs = frame(spark, rows).withColumn("spans", F.lit("clash")).withColumn("item_id", F.lit(1))
    out = decontam.overlaps(spark, docs, spark.createDataFrame(items, ITEMS))
    assert out.columns == [*docs.drop("spans").columns, "spans"]
    got = {(r.doc_id, s.item_id) for r in out.collect() for s in r.spans}
    want = {(r[0], i) for r in rows for i, t in items if brute(r[1], t)}
    assert got == want and len({d for d, _ in got if d < 40}) > 30


def test_blocks(spark, monkeypatch):
    items, rows = planted()
    bench = spark.createDataFrame(items, ITEMS)
    one = decontam.overlaps(spark, frame(spark, rows), bench).collect()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    many = decontam.overlaps(spark, frame(spark, rows), bench).collect()
    key = lambda r: (r.doc_id, sorted(map(tuple, r.spans)))
    assert len(list(decontam._blocks(bench))) > 2
    assert sorted(map(key, one)) == sorted(map(key, many))


@pytest.mark.parametrize("items", [[], [(1, "one two three")]])
def test_empty(spark, items):
    bench = spark.createDataFrame(items, ITEMS)
    assert decontam.overlaps(spark, frame(spark, []), bench).count() == 0
    assert all(not r.spans for r in decontam.overlaps(spark, frame(spark, odd_docs()), bench).collect())


def test_documents(spark):
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r.item_ids for r in decontam.query(spark, path).collect()}
    items = spark.read.parquet(f"{path}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    for d in docs:
        exact = {i.item_id for i in items if " ".join(words(i.text)) in " ".join(words(d.text))}
        assert exact <= set(got[d.doc_id])


def any_stretch(same):
    """Most equal words of all stretches with at most one changed word to four equal ones, one by one."""
    return max((e for b in range(len(same)) for c in range(b + 1, len(same) + 1) if 4 * (c - b - (e := sum(same[b:c]))) <= e), default=0)


def test_stretch_is_best_of_all():
    rnd = random.Random(5)
    for _ in range(400):
        same = np.array([rnd.random() < rnd.choice([0.5, 0.8, 0.9]) for _ in range(rnd.randrange(0, 40))], bool)
        begin, end, equal = decontam.stretch(same)
        assert equal == any_stretch(same.tolist()) == same[begin:end].sum() and 4 * (end - begin - equal) <= equal


def test_changed_words(spark):
    """Each item once, with words changed: every one of 14, as many as a short item may have, one more, and random ones."""
    rnd, vocab = vocabulary()
    plan = [(14, [k]) for k in range(14)]
    plan += [(n, rnd.sample(range(n), c)) for n in range(1, 14) for c in (0, n // 5, n // 5 + 1) for _ in range(5)]
    plan += [(n, rnd.sample(range(n), c)) for n, c in ((15, 1), (20, 3), (30, 6), (40, 8)) for _ in range(40)]
    items, rows, want = [], [], set()
    for k, (n, places) in enumerate(plan):
        w = [f"{rnd.choice(vocab)}{k}" for _ in range(n)]
        items.append((k, " ".join(w)))
        same = [j not in places for j in range(n)]
        body = [x if s else "changed" for x, s in zip(w, same, strict=True)]
        rows.append((k, " ".join([*rnd.choices(vocab, k=20), *body, *rnd.choices(vocab, k=20)]), "en", "s", 0))
        if 4 * len(places) <= sum(same) if n <= 13 else any_stretch(same) >= 13:
            want.add(k)
    out = decontam.overlaps(spark, frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    got = {r.doc_id for r in out if r.spans}
    exact = {k for k, (n, _) in enumerate(plan) if n <= 14}
    assert got <= want and got & exact == want & exact
    assert len(got) >= 0.99 * len(want)


def test_capitals_beyond_ascii(spark):
    """Final sigma, dotted capital I, and others: an item is found in itself, in upper, lower and mixed case."""
    texts = ["Ο ΣΟΦΟΣ ΟΔΥΣΣΕΥΣ ΚΑΙ Ο ΛΑΟΣ ΤΗΣ ΙΘΑΚΗΣ ΕΙΔΑΝ ΤΟΝ ΚΟΣΜΟ ΤΗΣ ΘΑΛΑΣΣΑΣ ΜΑΖΙ ΧΘΕΣ", "İSTANBUL İLE İZMİR ARASINDA IŞIKLI BİR YOL VARDI VE İNSANLAR ORADA IRMAK KIYISINDA İYİ YAŞARDI", "STRASSE ÉTÉ ÆON ЖИЗНЬ МИР ДОМ КОТ ЛЕС РЕКА ПОЛЕ СНЕГ ВЕСНА ЛЕТО ОСЕНЬ"]
    rows = [(i, t, "x", "s", 0) for i, t in enumerate(texts)] + [(10, texts[2].lower(), "x", "s", 0), (11, texts[2].title(), "x", "s", 0)]
    out = decontam.overlaps(spark, frame(spark, rows), spark.createDataFrame(list(enumerate(texts)), ITEMS)).collect()
    assert {r.doc_id: {s.item_id for s in r.spans} for r in out} == {0: {0}, 1: {1}, 2: {2}, 10: {2}, 11: {2}}


def test_long_text_that_repeats_itself(monkeypatch):
    """Hits of an 80,000-word text of one word with an item of the same word: some 124 million pairs, held a piece at a time."""
    probe = decontam.Probe([(1, "so " * 400), (2, "other words that are not there at all in this text but are many enough")])
    most = []
    found = decontam.Probe._found

    def watched(*a, **k):
        for x in found(*a, **k):
            most.append(len(x[0]))
            yield x

    monkeypatch.setattr(decontam.Probe, "_found", staticmethod(watched))
    text = W.Words(np.frombuffer(b"so " * 80_000, np.uint8), np.array([0, 240_000]), decontam.PARTS)
    spans = list(probe.matches(text))
    assert max(most) <= decontam.PAIRS and sum(most) < 400_000
    assert {s[1] for s in spans} == {1} and max(s[4] for s in spans) == 400
