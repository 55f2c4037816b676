"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of the n-grams that are typical of it. All filters share their hash functions
and lie side by side: slot i of one array holds bit i of every language's filter, so the AND of an n-gram's
slots is the bitmask of all languages that hold it; a slot has as many words of 64 bits as the languages need. A text's n-grams are counted for each language, the counts
are corrected for what a filter passes by chance, and the largest share decides.

The filters are fitted on a bounded, hash-chosen sample (SAMPLE texts a language), so that a language's filter is of
bounded size and all can be broadcast; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm import words as W

NGRAM = 4
#: Documented bounds, for each language: texts in the fit, n-grams in its filter. Languages are not bounded.
SAMPLE, GRAMS = 3000, 100_000
#: n-gram counts that a task holds before it sends them on.
HELD = 1 << 20
#: An n-gram is typical of a language in which it has at least this part of its highest frequency.
TYPICAL = 0.4
LEAST_COUNT = 3
HASHES, SLOTS_PER_GRAM = 3, 12
FOLDS = 5
PLACES = 1 << 40
UNKNOWN = "und"

_fold = np.arange(256, dtype=np.uint8)
_fold[[c for c in range(128) if not chr(c).isalpha()]] = 32
_letter = np.zeros(256, bool)
_letter[[c for c in range(128) if chr(c).isalpha()]] = True


def held_out(doc_id: Column) -> Column:
    """Rows from which nothing is learned by rule; a row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, text after the last, hash of each n-gram, and where each text's begin. Lower case; what is
    no letter in ASCII counts as a blank; three blanks stand around each text."""
    data, at = W.buffers(pc.utf8_lower(texts))
    for i, j in W.groups(at):
        size = np.diff(at[i : j + 1])
        begin = np.cumsum(size + 3) - size
        out = np.full(int(size.sum()) + 3 * len(size) + 3, 32, np.uint8)
        out[np.arange(at[j] - at[i]) + np.repeat(begin - (at[i:j] - at[i]), size)] = _fold[data[at[i] : at[j]]]
        x = np.zeros(len(out) - NGRAM + 1, W.U)
        for k in range(NGRAM):
            x = (x << W.U(8)) | out[k : len(x) + k]
        first = np.r_[begin - 3, len(x)]
        blank = x == W.U(0x20202020)
        x = W.mix(x)
        x[blank] = 0
        yield i, j, x, first


def _count(languages: list[str]):
    """n-gram counts of each language in a task's texts."""
    place = {x: k for k, x in enumerate(languages)}

    def sent(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, key in enumerate(keys):
            for a in range(0, len(key), 1 << 16):
                z = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(W.as_signed(key[z])), pa.array(np.full(len(key[z]), k, np.int32)), pa.array(counts[k][z])], names=["gram", "k", "n"])
            keys[k], counts[k] = np.zeros(0, W.U), np.zeros(0, np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, W.U)] * len(languages), [np.zeros(0, np.int64)] * len(languages)
        for b in parts:
            lang = np.array([place[x] for x in b.column("lang").to_pylist()])
            for i, j, x, first in grams(b.column("text")):
                which = np.repeat(lang[i:j], np.diff(first))
                mine = x[first[0] :]
                for k in np.unique(which):
                    new, n = np.unique(mine[(which == k) & (mine != 0)], return_counts=True)
                    both, inverse = np.unique(np.concatenate([keys[k], new]), return_inverse=True)
                    counts[k] = np.bincount(inverse, np.concatenate([counts[k], n]), len(both)).astype(np.int64)
                    keys[k] = both
                if sum(map(len, keys)) > HELD:
                    yield from sent(keys, counts)
        yield from sent(keys, counts)

    return run


class Filters:
    """The bit-sliced filters of some languages. masks: of shape n-grams x words of 64 languages each, or n-grams if one
    word is enough."""

    def __init__(self, languages: list[str], grams: np.ndarray, masks: np.ndarray, usual: int) -> None:
        self.languages, self.usual = languages, usual
        bits = max(10, int(np.ceil(np.log2(max(1, SLOTS_PER_GRAM * len(grams) / max(1, min(len(languages), 8)))))))
        self.low = W.U((1 << bits) - 1)
        self.slots = np.zeros((1 << bits, *masks.shape[1:]), W.U)
        for at in self._places(grams):
            np.bitwise_or.at(self.slots, at, masks)
        self.chance = np.array([self._bits(self.slots, k).mean() ** HASHES for k in range(len(languages))])

    @staticmethod
    def _bits(masks: np.ndarray, k: int) -> np.ndarray:
        """The bit of language k."""
        word = masks if masks.ndim == 1 else masks[:, k // 64]
        return (word >> W.U(k % 64)) & W.U(1)

    def _places(self, x: np.ndarray) -> list[np.ndarray]:
        return [((x >> W.U(21 * k)) & self.low).astype(np.int64) if k < 2 else (W.mix(x) & self.low).astype(np.int64) for k in range(HASHES)]

    def holding(self, x: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that hold each n-gram."""
        a, b, c = self._places(x)
        return self.slots[a] & self.slots[b] & self.slots[c]

    def shares(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text, each language's part of the corrected counts."""
        mask = self.holding(x)
        mask[x == 0] = 0
        known = np.diff(np.r_[0, np.cumsum(x != 0)][first]).astype(float)
        found = np.empty((len(first) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            upto = np.concatenate([[0], np.cumsum(self._bits(mask, k))]).astype(float)
            found[:, k] = np.diff(upto[first])
        fixed = np.maximum(0, (found - known[:, None] * self.chance) / (1 - self.chance))
        total = fixed.sum(1)
        even = total == 0
        fixed[even, self.usual] = 1
        total[even] = len(self.languages)
        return fixed / total[:, None]


def fit(spark: SparkSession, docs: DataFrame) -> Filters | None:
    """Filters from docs (doc_id, text, lang): rows that aren't held out, with text, lang and doc_id. None if
    there are none."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return None
    usual = languages.index(found[0]["lang"])
    # ids are told apart by a hash; only those low enough to be among a language's first SAMPLE are ranked
    share = F.create_map(*(F.lit(x) for r in found for x in (r["lang"], min(PLACES, int(PLACES * 1.2 * SAMPLE / r["count"]) + 1))))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    placed = known.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place"))
    picked = placed.filter(F.col("place") < share[F.col("lang")]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE)
    ids = picked.select("doc_id").distinct()  # SAMPLE ids a language at most
    # an id on many rows counts once a language, with its least text
    texts = known.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    each = texts.mapInArrow(_count(languages), "gram bigint, k int, n bigint").groupBy("gram", "k").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("k").orderBy(F.desc("n"), "gram")
    each = each.filter(F.col("n") >= LEAST_COUNT).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= GRAMS).select("gram", "k", "n")
    rows = each.toPandas()  # GRAMS a language at most
    gram, at = np.unique(rows["gram"].to_numpy(np.int64), return_inverse=True)
    k, n = rows["k"].to_numpy(), rows["n"].to_numpy().astype(float)
    part = n / np.maximum(1, np.bincount(k, n, len(languages)))[k]
    most = np.zeros(len(gram))
    np.maximum.at(most, at, part)
    typical = part >= TYPICAL * most[at]
    masks = np.zeros((len(gram), -(-len(languages) // 64)), W.U)
    np.bitwise_or.at(masks, (at[typical], k[typical] // 64), W.U(1) << (k[typical] % 64).astype(W.U))
    return Filters(languages, gram.view(W.U), masks, usual)


def _predict(shared):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for b in parts:
            data, at = W.buffers(b.column("text"))
            plain = np.concatenate([[0], np.cumsum(_letter[data[at[0] : at[-1]]])])
            lettered = np.diff(plain[at - at[0]]) > 0
            pred, score = [], []
            if filters:
                for i, j, x, first in grams(b.column("text")):
                    share = filters.shares(x, first)
                    best = share.argmax(1)
                    pred += [filters.languages[k] for k in best]
                    score += share[np.arange(j - i), best].tolist()
            else:
                pred, score = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            for i in np.flatnonzero(~lettered):
                if not any(c.isalpha() for c in bytes(data[at[i] : at[i + 1]]).decode()):
                    pred[i], score[i] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang; more columns are left out).
    lang_pred: und, score 0, where the text is null or has no letter, and everywhere if no language is known. A
    text with letters but without a known n-gram gets the commonest language and the score 1 / languages. Very long texts are scored
    whole, a text at a time. Ties
    go to the first language by code point. Repeated rows are judged alike. Empty table: no rows."""
    shared = spark.sparkContext.broadcast(fit(spark, docs))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
