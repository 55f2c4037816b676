"""Substring deduplication by level-wise doubling.

A word goes if a window of min_words words that covers it also starts in a document with a smaller id.
Level one: windows of half that length. Every full window holds one anchor, the half window in it with the least
hash, so equal full windows have equal anchors, and anchors are a quarter of all half windows. Anchors that
no second document has are dropped: no full window around them can repeat. Level two: full windows whose anchor
survived, hashed at twice the length (cut to min_words). A repeat longer than min_words is a chain of
repeated full windows, so higher levels could remove no further word, and the doubling ends there.

A level is an exchange of (hash, id) pairs, packed: a task sorts its pairs by hash, cuts them at the borders of the
hash ranges and sends each range as one compressed blob. Of a hash that several of its documents hold, it sends
one pair, with the least id, and settles the others itself; so a passage that a third of all documents share
sends one pair a block of texts to its range, not one a document. What comes back is the set of
hashes that concern a document, so texts are shuffled once, compressed, for both levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import words as W

MIN_WORDS = 13
#: Window hashes that a task settles together, and bytes of text to a hash range.
BLOCK, RANGE_BYTES = 1 << 20, 8 << 20
#: Id that stands for a missing one.
NO_ID = (1 << 63) - 1
PAIRS = "range int, settled boolean, n int, blob binary"
FOUND = "id bigint, hash bigint"

Batches = Iterator[pa.RecordBatch]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, all highest ones first: small numbers compress to little."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view("<u8").reshape(n)


def _blob(h: np.ndarray, ids: np.ndarray) -> bytes:
    low = ids.min()
    return zstandard.compress(np.int64(low).tobytes() + _planes(np.diff(h, prepend=W.U(0))) + _planes((ids - low).view(W.U)), 1)


def _unblob(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    return np.cumsum(_numbers(data[8:], n), dtype=W.U), _numbers(data[8 + 8 * n :], n).view(np.int64) + np.frombuffer(data, np.int64, 1)


def _sorted_pairs(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by hash and id, where each hash begins, and the number of its ids."""
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])]
    h, ids = h[new], ids[new]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h, ids, first, np.diff(np.r_[first, len(h)])


class _Block:
    """Pairs of one task, settled and sent on when there are many."""

    def __init__(self, ranges: int, *, low_too: bool) -> None:
        """low_too: the least id of a repeated hash is found as well, not only those above it."""
        self.ranges, self.low_too, self.rows, self.size = ranges, low_too, [], 0

    def add(self, h: np.ndarray, ids: np.ndarray) -> Batches:
        if len(h):
            self.rows.append((h, ids))
            self.size += len(h)
        if self.size >= BLOCK:
            yield from self.flush()

    def _range(self, x: np.ndarray) -> np.ndarray:
        return (((x >> W.U(32)) * W.U(self.ranges)) >> W.U(32)).astype(np.int64)

    def flush(self) -> Batches:
        if not self.size:
            return
        h, ids, first, count = _sorted_pairs(*(np.concatenate(x) for x in zip(*self.rows, strict=True)))
        self.rows, self.size = [], 0
        settled = np.repeat(count > 1, count)
        if not self.low_too:
            settled[first] = False
        home = self._range(W.mix(ids[settled].view(W.U)))
        order = np.argsort(home, kind="stable")
        out = []
        for done, a, b, to in ((False, h[first], ids[first], self._range(h[first])), (True, h[settled][order], ids[settled][order], home[order])):
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, np.int64)
            out += [(int(to[i]), done, int(j - i), _blob(a[i:j], b[i:j])) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        names = ["range", "settled", "n", "blob"]
        for i in range(0, len(out), 1000):
            some = list(zip(*out[i : i + 1000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, (pa.int32(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], names=names)


def _meet(low_too: bool) -> Callable[[pa.Table], pa.Table]:
    """A hash range: for each document, the hashes that a document with another (or only a smaller) id has too."""

    def run(rows: pa.Table) -> pa.Table:
        here, done = [], []
        for settled, n, blob in zip(rows["settled"].to_pylist(), rows["n"].to_pylist(), rows["blob"].to_pylist(), strict=True):
            (done if settled else here).append(_unblob(blob, n))
        if here:
            h, ids, first, count = _sorted_pairs(*(np.concatenate(x) for x in zip(*here, strict=True)))
            hit = np.repeat(count > 1, count)
            if not low_too:
                hit[first] = False
            done.append((h[hit], ids[hit]))
        h, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(ids, kind="stable")
        return pa.table({"id": pa.array(ids[order], pa.int64()), "hash": pa.array(W.as_signed(h[order]), pa.int64())})

    return run


def _level_one(n: int, ranges: int) -> Callable[[Batches], Batches]:
    half = -(-n // 2)

    def run(parts: Batches) -> Batches:
        block = _Block(ranges, low_too=True)
        for b in parts:
            ids = b.column("id").to_numpy()
            for i, _, words in W.batches(b.column("text")):
                at, doc = W.starts(words, n)
                if len(at):
                    h = W.rolled(words, half)
                    place = W.least(h, at, n - half + 1)
                    new = np.r_[True, place[1:] != place[:-1]]
                    yield from block.add(h[place[new]], ids[doc[new] + i])
        yield from block.flush()

    return run


def _packed(parts: Batches) -> Batches:
    """Texts compressed for their way through the shuffle."""
    z = zstandard.ZstdCompressor(level=3)
    for b in parts:
        data, at = W.buffers(b.column("text"))
        packed = pa.array([z.compress(data[at[i] : at[i + 1]]) for i in range(len(at) - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), packed], names=["doc_id", "id", "packed"])


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray | None]]:
    """Place, text and found hashes of each row."""
    un = zstandard.ZstdDecompressor()
    for i, (z, hits) in enumerate(zip(b.column("packed"), b.column("hits"), strict=True)):
        yield i, un.decompress(z.as_py()), hits.values.to_numpy().view(W.U) if hits.is_valid else None


def _words(text: bytes) -> W.Words:
    return W.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))


def _level_two(n: int, ranges: int) -> Callable[[Batches], Batches]:
    half = -(-n // 2)

    def run(parts: Batches) -> Batches:
        block = _Block(ranges, low_too=False)
        for b in parts:
            ids = b.column("id").to_numpy()
            for i, text, hits in _texts(b):
                words = _words(text)
                at, _ = W.starts(words, n)
                if len(at):
                    h = W.rolled(words, half)
                    at = at[np.isin(h, hits)[W.least(h, at, n - half + 1)]]
                    yield from block.add(W.rolled(words, n)[at], np.full(len(at), ids[i]))
        yield from block.flush()

    return run


def _kept(n: int) -> Callable[[Batches], Batches]:
    def run(parts: Batches) -> Batches:
        for b in parts:
            counts, removed, kept = [], [], []
            for _, text, hits in _texts(b):
                own = text.split()
                gone = np.zeros(len(own) + 1, np.int64)
                if hits is not None and len(own) >= n:
                    at = np.flatnonzero(np.isin(W.rolled(_words(text), n), hits))
                    gone[at] += 1
                    gone[at + n] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                counts.append(len(own))
                removed.append(len(own) - int(keep.sum()))
                kept.append(b" ".join(own if keep.all() else [w for w, k in zip(own, keep.tolist(), strict=True) if k]).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def _found(pairs: DataFrame, *, low_too: bool) -> DataFrame:
    return pairs.groupBy("range").applyInArrow(_meet(low_too), FOUND).groupBy("id").agg(F.collect_list("hash").alias("hits"))


def dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs (doc_id, text; more columns are left out). kept: the
    words kept, joined by one space. Words are runs without ASCII blanks. Null text: no words. A missing
    doc_id counts as larger than any other, and rows that lack it, or that have the same one, aren't each other's
    repeats. Repeated rows are rows like any other. Empty table: no rows. Windows are told apart by 64-bit hashes."""
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    alive = _found(base.select("id", "text").mapInArrow(_level_one(min_words, ranges), PAIRS), low_too=True)
    packed = base.mapInArrow(_packed, "doc_id bigint, id bigint, packed binary")
    pairs = packed.join(alive, "id").select("id", "packed", "hits").mapInArrow(_level_two(min_words, ranges), PAIRS)
    repeated = _found(pairs, low_too=False)
    return packed.join(repeated, "id", "left").select("doc_id", "packed", "hits").mapInArrow(_kept(min_words), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM win JOIN least USING (s) WHERE low < doc_id)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
