import hashlib
import re
from collections import Counter

import pytest
from cases import frame, odd_docs, saved
from compare import check_query
from pyspark.sql import functions as F

from ledgerlight.llm import substrings


def brute(rows, n=13):
    """Every window of every document, in a dictionary."""
    split = [(substrings.NO_ID if r[0] is None else r[0], r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first = {}
    for i, _, w in split:
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, raw, w in split:
        gone = set()
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < i:
                gone.update(range(a, a + n))
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((raw, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def run(spark, path):
    return [tuple(r) for r in substrings.query(spark, path).collect()]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_odd_rows(spark, tmp_path, block, monkeypatch):
    rows = odd_docs()
    line = " ".join(f"common{i}" for i in range(14))
    rows += [(500 + i, f"a{i} b{i} {line} c{i} {line}\n{line}", "en", "s", 1) for i in range(40)]
    monkeypatch.setattr(substrings, "BLOCK", block)
    got = run(spark, saved(spark, tmp_path, rows))
    assert Counter(got) == Counter(brute(rows))


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(run(spark, "/root/testdata/sf0.01")) == Counter(brute(rows))


@pytest.mark.parametrize("n", [2, 5, 50])
def test_other_lengths(spark, n):
    rows = odd_docs()
    out = substrings.dedup(spark, frame(spark, rows).withColumn("id", F.lit("clash")).withColumn("range", F.lit(0)), n)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()]
    assert Counter(got) == Counter(brute(rows, n))


def test_empty(spark, tmp_path):
    assert run(spark, saved(spark, tmp_path, [])) == []


def test_against_sql(spark):
    assert len(check_query(spark, "/root/testdata/sf0.01", substrings.query, substrings.SQL)) == 1000
