"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the words of a span and skip the others, so a changed word inside a passage breaks only
the masks that look at it. Hashes of the masked words of every benchmark item are held against those of every
place of every document; around each hit the two texts are aligned, and the stretch with the most equal words, of
all with few enough changed words, decides. An item of MIN_WORDS words or fewer is searched for by pieces, one of
which is whole however the changed words it may have lie. Texts are compared as lower-cased words without ASCII punctuation.

The benchmark goes out in blocks of bounded size: a block is a broadcast of at most BLOCK_BYTES of text, and
a larger benchmark means more blocks, each held against all documents, one after the other: what a block has found
is written before the next one goes out. No document is shuffled. Hits are gone through in bounded pieces, and of a run
of hits on one diagonal only the first counts, so a text that repeats itself takes no more memory than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import words as W
from ledgerlight.llm.workspace import dropped, written

#: Masks of the words that count, 1, and those that don't, 0.
MASKS = ("11111111", "1101100101011", "110010100110111", "1110100010110011")
#: A stretch contaminates from so many matching words on (or if it covers an item of no more words), ...
MIN_WORDS = 13
#: ... with so many changed words for each matching one at most.
CHANGED = 0.25
BLOCK_BYTES = 8 << 20
#: Pairs of equal hashes that are looked at together.
PAIRS = 1 << 20
PARTS = W.separators(bytes(c for c in range(128) if not chr(c).isalnum()))


class Probe:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        data, at = W.buffers(lowered(pa.array([t for _, t in items], pa.large_string())))
        self.words = W.Words(data[at[0] : at[-1]], at - at[0], PARTS)
        self.ids = [i for i, _ in items]
        self.item_of = np.repeat(np.arange(len(items)), self.words.counts)
        found = [self._masked(self.words, m) for m in range(len(MASKS))]
        # short items: so many pieces, of equal length or nearly, that changed words can't break all
        pieces: dict[int, list[int]] = {}
        for i, n in enumerate(self.words.counts.tolist()):
            if 0 < n <= MIN_WORDS:
                edges = [n * j // (changeable(n) + 1) for j in range(changeable(n) + 2)]
                for e0, e1 in zip(edges, edges[1:], strict=False):
                    pieces.setdefault(e1 - e0, []).append(int(self.words.first[i]) + e0)
        short = {n: (W.rolled(self.words, n)[np.array(v)], np.array(v)) for n, v in pieces.items()}
        self.tables = [self._table(h, p) for h, p in found]
        self.short_tables = {n: self._table(h, p) for n, (h, p) in short.items()}

    @staticmethod
    def _masked(words: W.Words, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes under a mask and the word each begins with."""
        mask = MASKS[m]
        at, _ = W.starts(words, len(mask))
        h = np.full(len(at), m + 1, W.U)
        for j, c in enumerate(mask):
            if c == "1":
                h = h * W.U(0x9E3779B97F4A7C15) + words.hashes[at + j]
        return W.mix(h), at

    @staticmethod
    def _table(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted hashes, their places, a bitmap over 20 hash bits that most other hashes fail, and the hash of the place
        before, if it is in the same item, else 0."""
        order = np.argsort(h, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[(h >> W.U(44)).astype(np.int64)] = True
        before = np.zeros(len(h), W.U)
        before[1:][place[1:] == place[:-1] + 1] = h[:-1][place[1:] == place[:-1] + 1]
        return h[order], place[order], seen, before[order]

    @staticmethod
    def _found(table: tuple, h: np.ndarray, at: np.ndarray, *, run: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (word of the document, word of the benchmark) of equal hashes, in pieces. run: leave out those that go on from
        a pair of the words before."""
        keys, place, seen, before = table
        maybe = np.flatnonzero(seen[(h >> W.U(44)).astype(np.int64)])
        lo, hi = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
        maybe, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        upto = np.concatenate([[0], np.cumsum(n)])
        goes_on = np.zeros(len(h), bool)
        goes_on[1:] = at[1:] == at[:-1] + 1
        for first in range(0, int(upto[-1]), PAIRS):
            pair = np.arange(first, min(first + PAIRS, int(upto[-1])))
            of = np.searchsorted(upto, pair, "right") - 1
            mine, k = maybe[of], lo[of] + pair - upto[of]
            if run:
                new = ~goes_on[mine] | (before[k] == 0) | (before[k] != h[mine - 1])
                mine, k = mine[new], k[new]
            yield at[mine], place[k]

    def hits(self, words: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for m, t in enumerate(self.tables):
            yield from self._found(t, *self._masked(words, m), run=True)
        for n, t in self.short_tables.items():
            at, _ = W.starts(words, n)
            for pair in self._found(t, W.rolled(words, n)[at], at, run=False):
                yield self._whole(words, *pair)

    def _whole(self, words: W.Words, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs around which a short item occurs whole, with few enough changed words."""
        item = self.item_of[theirs]
        n, a0 = self.words.counts[item], self.words.first[item]
        d0 = mine - (theirs - a0)
        doc = np.searchsorted(words.first, mine, "right") - 1
        inside = (d0 >= words.first[doc]) & (d0 + n <= words.first[doc + 1])
        mine, theirs, n, a0, d0 = mine[inside], theirs[inside], n[inside], a0[inside], d0[inside]
        changed = np.zeros(len(mine), np.int64)
        for j in range(MIN_WORDS):
            has = np.flatnonzero(n > j)
            changed[has] += words.hashes[d0[has] + j] != self.words.hashes[a0[has] + j]
        good = changed <= CHANGED * (n - changed)
        return mine[good], theirs[good]

    def matches(self, words: W.Words) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, item, first word of the stretch in the text, its length, and how many of its words are equal."""
        diagonals: set[tuple[int, int, int]] = set()
        for mine, theirs in self.hits(words):
            doc = np.searchsorted(words.first, mine, "right") - 1
            diagonals.update(zip(doc.tolist(), self.item_of[theirs].tolist(), (mine - theirs).tolist(), strict=True))
        for d, i, diagonal in sorted(diagonals):
            a0, a1 = self.words.first[i], self.words.first[i + 1]
            lo, hi = max(words.first[d], a0 + diagonal), min(words.first[d + 1], a1 + diagonal)
            same = words.hashes[lo:hi] == self.words.hashes[lo - diagonal : hi - diagonal]
            if a1 - a0 <= MIN_WORDS:
                begin, end, equal = 0, len(same), int(same.sum())
                good = end == a1 - a0 and end - equal <= CHANGED * equal
            else:
                begin, end, equal = stretch(same)
                good = equal >= MIN_WORDS
            if good:
                yield d, self.ids[i], int(lo + begin - words.first[d]), end - begin, equal


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case, for documents and items alike."""
    return pc.utf8_lower(texts)


def changeable(n: int) -> int:
    """How many of n words may be changed."""
    return int(CHANGED * n / (1 + CHANGED) + 1e-9)


def stretch(same: np.ndarray) -> tuple[int, int, int]:
    """The run with the most equal words of all with CHANGED changed words for each equal one at most, that is, whose sum of 1
    for an equal word and -1/CHANGED for a changed one isn't negative: begin, end, equal words. For each end, the
    earliest begin with such a sum has the most."""
    upto = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -1.0 / CHANGED))])
    count = np.concatenate([[0], np.cumsum(same)])
    begins = np.searchsorted(-np.minimum.accumulate(upto), -upto, "left")
    end = int(np.argmax(count - count[begins]))
    begin = int(begins[end])
    while begin < end and not same[begin]:
        begin += 1
    return begin, end, int(count[end] - count[begin])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded text, one at a time on the driver; an item larger than a block is one by itself."""
    block, size = [], 0
    rows = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates()
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


SPANS = "array<struct<item_id: bigint, first_word: int, n_words: int, n_equal: int>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("n_equal", pa.int32())]))


def _search(probe, into: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what a block has found to column into."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = probe.value
        for b in parts:
            found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(b.num_rows)]
            for i, _, words in W.batches(lowered(b.column("text")), PARTS):
                for d, *m in p.matches(words):
                    found[i + d].append(tuple(m))
            spans = [[dict(zip(("item_id", "first_word", "n_words", "n_equal"), m, strict=True)) for m in sorted(x)] for x in found]
            old = b.column(into).to_pylist()
            both = pa.array([(o or []) + s for o, s in zip(old, spans, strict=True)], _KIND)
            yield pa.RecordBatch.from_arrays([both if c == into else b.column(c) for c in b.schema.names], names=b.schema.names)

    return run


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, into: str = "spans") -> DataFrame:
    """The rows of docs with into, a list of (item_id, first_word, n_words, n_equal) of the stretches that overlap a
    benchmark item (item_id, text); empty for a clean text. Other columns of docs are kept; one named like into is
    replaced. Null and empty texts are clean, null and wordless items match nothing, repeated rows are judged
    alike, an item of MIN_WORDS words or fewer must occur whole, but for its changed words. Very long texts are searched whole, each in memory
    proportional to its length. Empty tables: no rows, or all clean."""
    out = docs.drop(into).withColumn(into, F.array().cast(SPANS))
    blocks, last = _blocks(benchmark), None
    block = next(blocks, None)
    while block:
        probe = spark.sparkContext.broadcast(Probe(block))
        out = out.mapInArrow(_search(probe, into), out.schema)
        if block := next(blocks, None):  # one block at a time is held by the driver and the executors
            table = written(out, "decontam-block")
            probe.destroy()
            if last is not None:
                dropped(last)
            out = last = table
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items and items (ids, ascending) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = overlaps(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return found.select("doc_id", (F.size("spans") > 0).alias("contaminated"), F.size(items).alias("n_items"), items.alias("item_ids"))
