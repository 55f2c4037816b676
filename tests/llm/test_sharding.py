import zlib

from cases import frame, odd_docs
from pyspark.sql import functions as F

from ledgerlight.llm import sharding


def brute(rows, shards=8):
    rows = sorted(((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows))
    total, before, out, slots = sum(r[3] for r in rows), 0, [], {}
    for _, i, crc, size in rows:
        s = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((i if _ else None, size, crc, "bytes", s, slots.setdefault(s, 0), None))
        slots[s] += 1
        before += size
    return out


def test_odd_rows(spark):
    rows = odd_docs()
    got = sharding.shard(spark, frame(spark, rows).withColumn("part", F.lit("clash")).withColumn("shard", F.lit(7)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.query(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 2 * max(r.size for r in got)


def test_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = sharding.write_shards(spark, docs, str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8


def test_files_with_missing_and_repeated_ids(spark, tmp_path):
    """Each physical row is in one shard, with the values it had, and shards and slots are those of brute force."""
    data = odd_docs() + [(7, f"same id {i % 3}", "en", "s", 1) for i in range(40)] + [(None, "x" * i, None, None, None) for i in range(9)]
    docs = frame(spark, data).repartition(3)
    back = sharding.write_shards(spark, docs, str(tmp_path / "odd"))
    got = [tuple(r) for r in back.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(got, key=repr) == sorted(data, key=repr)
    placed = [(r.doc_id, r.size, r.text_crc32, "bytes", r.shard, r.slot, None) for r in back.collect()]
    assert sorted(placed, key=repr) == sorted(brute(data), key=repr)


def test_empty(spark):
    assert sharding.sharded(spark, frame(spark, [])).count() == 0
    assert sharding.shard(spark, frame(spark, [])).count() == 0
