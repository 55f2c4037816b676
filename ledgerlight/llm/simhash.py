"""Document fingerprints by SimHash, and a search for near ones through permuted block tables.

Terms are pairs of neighbouring words, weighted by 1 + ln(occurrences). Each term's hash votes with its weight, for
or against, on each of BITS bits; the sign of the sum is the fingerprint's bit. Likeness is the part of equal
bits. Search: two fingerprints within a radius differ in at most radius blocks, so of radius + match blocks
at least match are equal. There is a table for each choice of match blocks, permuted to the front as its key; rows
that meet in a table are compared whole, so every fingerprint within the radius is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm import words as W
from ledgerlight.llm.workspace import written

BITS, TERM_WORDS = 128, 2
RADIUS, MATCH = 5, 2
#: Characters of text that a task works on together.
CHUNK = 1 << 18
_SIDES = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) == 1, 1.0, -1.0)
_SALT = W.U(0x9E3779B97F4A7C15)
Batches = Iterator[pa.RecordBatch]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of BITS / 8 bytes for each text; all zero without words."""
    at = np.cumsum([0, *map(len, texts)])
    h, _, doc = W.Words(np.frombuffer(b"".join(texts), np.uint8), at).windows(TERM_WORDS, short=True)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    if not len(h):
        return out
    own = W.mix(h ^ W.mix(doc.astype(W.U)))
    order = np.lexsort((own, doc))
    own = own[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    n = np.diff(np.r_[first, len(own)])
    terms, doc = h[order][first], doc[order][first]
    weight = np.rint(16 * (1 + np.log(n)))  # whole numbers: sums don't depend on their order
    parts = [terms] + [W.mix(terms + W.U(k) * _SALT) for k in range(1, BITS // 64)]
    bins = np.ascontiguousarray(np.stack(parts, 1)).view(np.uint8).astype(np.int64) + 256 * np.arange(BITS // 8)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in np.flatnonzero(np.diff(edges)):
        mine = slice(edges[d], edges[d + 1])
        votes = np.bincount(bins[mine].reshape(-1), np.repeat(weight[mine], BITS // 8), 32 * BITS).reshape(-1, 256) @ _SIDES
        out[d] = np.packbits(votes > 0, axis=1).reshape(-1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(-1) / BITS


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _rows(ids: list[int | None], texts: list[bytes], nexts: list[bytes], own: np.ndarray, other: np.ndarray) -> list[list]:
    whole = [t.decode() for t in texts]
    new = [edited(t, n.decode()).encode() for t, n in zip(whole, nexts, strict=True)]
    after = fingerprints(new)
    return [ids, [len(t) for t in whole], [hashlib.sha256(t).hexdigest() for t in new], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in after], likeness(own, after).tolist(), likeness(own, other).tolist()]


def _along(parts: Batches) -> Batches:
    """A sorted partition: rows whose next document is in it, and the two at its ends, which wait for their neighbours."""
    part, un = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
    ids: list = []
    texts: list[bytes] = []
    size, begun = 0, False

    def batch(cols: list, kind: str, packed: bytes | None = None) -> pa.RecordBatch:
        n = len(cols[0])
        cols = [pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([part] * n, pa.int64()), pa.array([kind] * n), pa.array([packed] * n, pa.binary())], names=[*_NAMES, "part", "kind", "packed"])

    def finished() -> Batches:
        """All that are held but the last."""
        marks = fingerprints(texts)
        yield batch(_rows(ids[:-1], texts[:-1], texts[1:], marks[:-1], marks[1:]), "row")

    def end(kind: str, i: int | None, text: bytes) -> pa.RecordBatch:
        return batch([[i], *([None] for _ in _NAMES[1:])], kind, zstandard.compress(text))

    for b in parts:
        for i, z in zip(b.column("doc_id").to_pylist(), b.column("packed"), strict=True):
            text = un.decompress(z.as_py())
            if not begun:
                begun = True
                yield end("head", i, text)
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size > CHUNK and len(ids) > 1:
                yield from finished()
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if begun:
        if len(ids) > 1:
            yield from finished()
        yield end("tail", ids[-1], texts[-1])


def _ends(parts: Batches) -> Batches:
    un = zstandard.ZstdDecompressor()
    for b in parts:
        texts = [un.decompress(z.as_py()) for z in b.column("packed")]
        nexts = [un.decompress(z.as_py()) for z in b.column("packed_next")]
        cols = _rows(b.column("doc_id").to_pylist(), texts, nexts, fingerprints(texts), fingerprints(nexts))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _pack(parts: Batches) -> Batches:
    z = zstandard.ZstdCompressor(level=3)
    for b in parts:
        data, at = W.buffers(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([z.compress(data[at[i] : at[i + 1]]) for i in range(len(at) - 1)], pa.binary())], names=["doc_id", "th", "packed"])


def fingerprinted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text; more columns are left out) its fingerprint, that of its edited text, and the
    likeness of its fingerprint to that one and to the next document's. Null text: empty. Order: ascending
    doc_id, nulls last, ties by a hash of the text; after the last comes the first, which may be the row itself.
    Equal texts have equal fingerprints; texts without words the all-zero one. Empty table: no rows.

    One range partitioning by id brings neighbours together, with texts compressed; the ends of the partitions,
    two rows each, are joined afterwards."""
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    packed = base.mapInArrow(_pack, "doc_id bigint, th bigint, packed binary")
    order = [F.col("doc_id").asc_nulls_last(), F.col("th")]
    lines = packed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "packed")
    done = written(lines.mapInArrow(_along, f"{OUT}, part bigint, kind string, packed binary"), "simhash-rows")
    heads = done.filter("kind = 'head'").select(F.col("part").alias("next"), F.col("packed").alias("packed_next"))
    parts = done.filter("kind = 'head'").select("part")  # a number for each partition
    succession = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    tails = done.filter("kind = 'tail'").select("part", "doc_id", "packed").join(succession, "part").join(heads, "next")
    ends = tails.select("doc_id", "packed", "packed_next").mapInArrow(_ends, OUT)
    return done.filter("kind = 'row'").select(*_NAMES).unionByName(ends)


def tables(radius: int = RADIUS, match: int = MATCH, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """Of each table, the bit ranges that make its key."""
    n = radius + match
    edges = [bits * i // n for i in range(n + 1)]
    return [[(edges[i], edges[i + 1]) for i in pick] for pick in combinations(range(n), match)]


def within(fingerprints_: DataFrame, queries: DataFrame, radius: int = RADIUS, match: int = MATCH) -> DataFrame:
    """Pairs query, fingerprint, distance of all distinct fingerprints (hexadecimal strings) within the radius of a
    distinct query, itself among them if present. DataFrame operations only; nulls match nothing."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col(df.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct()
        binary = F.concat(*(F.lpad(F.conv(F.substring(name, i + 1, 8), 16, 2), 32, "0") for i in range(0, BITS // 4, 8)))
        rows = one.withColumn("bin", binary)
        keys = [F.xxhash64(F.lit(t), *(F.substring("bin", a + 1, b - a) for a, b in table)) for t, table in enumerate(tables(radius, match))]
        return rows.select(name, F.explode(F.array(*keys)).alias("key"))

    words = lambda c: [F.conv(F.substring(c, i + 1, 8), 16, 10).cast("bigint") for i in range(0, BITS // 4, 8)]
    pairs = keyed(queries, "query").join(keyed(fingerprints_, "fingerprint"), "key")
    distance = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(words("query"), words("fingerprint"), strict=True)), F.lit(0))
    return pairs.withColumn("distance", distance).filter(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


#: Every row with an id that this divides is a query of the search.
EACH = 50


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprinted() with n_within: for ids that EACH divides, how many distinct fingerprints of the table lie within RADIUS bits
    of the row's, its own among them; null for other rows."""
    out = fingerprinted(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    asks = F.coalesce(F.col("doc_id") % EACH == 0, F.lit(False))
    asking = out.filter(asks)
    found = within(out.select("fingerprint"), asking.select("fingerprint")).groupBy("query").agg(F.count(F.lit(1)).alias("n_within"))
    answered = asking.join(found, F.col("fingerprint") == F.col("query")).select(*out.columns, "n_within")
    return out.filter(~asks).withColumn("n_within", F.lit(None).cast("bigint")).unionByName(answered)
