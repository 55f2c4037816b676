"""Toxicity by weak supervision.

Voters are words of a small lexicon, and words and patterns mined from labelled texts: a pattern is a beginning that
one or several different words of a text share. A voter votes on every text in which it occurs. A generative label model with one hidden label explains the votes of all
learnable documents, labelled or not: expectation maximisation estimates how often each voter fires on toxic and on
clean texts, and second moments given the hidden label show which voters repeat each other; a voter counts
for less the more it is correlated with others. The model's posterior labels of a bounded sample, joined with
their given labels, train a linear classifier over the mined vocabulary, which scores whole texts.

What the driver holds is bounded by SAMPLE, VOCABULARY and VOTERS, not by the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.workspace import written

FOLDS, FOLD_OUT = 4, 2
THRESHOLD = 0.3
#: Documented bounds: labelled texts of each label in the fit, features of the classifier, voters.
SAMPLE = {1: 3000, 0: 6000}
VOCABULARY, VOTERS = 1500, 60
#: Beginnings of words that patterns look at.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Numbers of different words of a text that share a beginning.
SHARED = (1, 2, 3, 5)
#: A feature is kept if its association with the label reaches this likelihood ratio.
LEAST_G2 = 15.0
#: Common insults.
LEXICON = ("bastard", "clown", "crap", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "shit", "stupid", "trash", "vermin", "worthless")
#: What is taken for a lexicon voter before anything is learned: how often it fires on toxic and on clean texts.
FIRES, MISFIRES, TOXIC = 0.2, 0.002, 0.05
STEPS, GOLD = 6, 4.0
CACHE = 1 << 20
#: Features whose counts a task holds before it sends them on.
HELD = 1 << 20
PLACES = 1 << 40

_word = re.compile(r"[^\W\d_]+")
Batches = Iterator[pa.RecordBatch]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD_OUT, F.lit(False))


def _signs(word: str) -> list[str]:
    """What a word may be known by: itself, and its beginnings."""
    return [f"={word}", *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


def _words(text: str) -> set[str]:
    return set(_word.findall(text.lower()))


def features(text: str) -> set[str]:
    """Voters that a text sets off: its words, and word beginnings that so many different words of it share."""
    n = Counter(f for w in _words(text) for f in _signs(w))
    return {f"{f}{t}" if t > 1 else f for f, k in n.items() for t in SHARED if k >= t}


class Reader:
    """Numbers of the known features that occur in a text."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.signs: dict[str, int] = {}
        self.steps: list[list[tuple[int, int]]] = []
        for i, f in enumerate(vocabulary):
            base, star, t = f.rpartition("*")
            sign = f if f[0] == "=" else base + star
            if sign not in self.signs:
                self.signs[sign] = len(self.steps)
                self.steps.append([])
            self.steps[self.signs[sign]].append((int(t or 1) if sign != f else 1, i))
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        if len(self.known) > CACHE:
            self.known.clear()
        n: dict[int, int] = {}
        for w in _words(text):
            ids = self.known.get(w)
            if ids is None:
                ids = self.known[w] = tuple(self.signs[f] for f in _signs(w) if f in self.signs)
            for i in ids:
                n[i] = n.get(i, 0) + 1
        return {i for s, k in n.items() for t, i in self.steps[s] if k >= t}


def _texts(b: pa.RecordBatch) -> Iterator[str]:
    return (x.as_py() or "" for x in b.column("text"))


def _counts(parts: Batches) -> Batches:
    """Toxic and clean texts in which each feature occurs, for a task's texts."""
    n: dict[str, list[int]] = {}

    def sent() -> Batches:
        rows = list(n.items())
        n.clear()
        for i in range(0, len(rows), 1 << 16):
            f, c = zip(*rows[i : i + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array([x[1] for x in c], pa.int64()), pa.array([x[0] for x in c], pa.int64())], names=["feature", "toxic", "clean"])

    for b in parts:
        for text, y in zip(_texts(b), b.column("y").to_pylist(), strict=True):
            for f in features(text):
                n.setdefault(f, [0, 0])[y] += 1
            if len(n) > HELD:
                yield from sent()
    yield from sent()


def _present(vocabulary: list[str]) -> Callable[[Batches], Batches]:
    def run(parts: Batches) -> Batches:
        read = Reader(vocabulary)
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([sorted(read(t)) for t in _texts(b)], pa.list_(pa.int32()))], names=["y", "ids"])

    return run


def _votes(voters: list[str]) -> Callable[[Batches], Batches]:
    def run(parts: Batches) -> Batches:
        read = Reader(voters)
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(1 << i for i in read(t)) for t in _texts(b)], pa.int64())], names=["votes"])

    return run


def _bits(votes: np.ndarray, m: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(m)) & 1).astype(float)


class LabelModel:
    """How often each voter fires on toxic and on clean texts, how common toxic texts are, and each voter's part in
    what it says, less for correlated voters."""

    def __init__(self, fires: np.ndarray, misfires: np.ndarray, toxic: float) -> None:
        self.fires, self.misfires, self.toxic, self.part = fires, misfires, toxic, np.ones(len(fires))

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b = np.clip(self.fires, 1e-6, 1 - 1e-6), np.clip(self.misfires, 1e-6, 1 - 1e-6)
        on, off = np.log(a / b) * self.part, np.log((1 - a) / (1 - b)) * self.part
        return np.log(self.toxic / (1 - self.toxic)) + off.sum() + x @ (on - off)


def _moments(model: LabelModel, pairs: bool) -> Callable[[Batches], Batches]:
    """Sums over a task's votes, weighted by each hidden label: firings of each voter (or pair of voters), and texts."""
    m = len(model.fires)

    def run(parts: Batches) -> Batches:
        total = np.zeros((2, m * m + 1 if pairs else m + 1))
        for b in parts:
            x, n = _bits(b.column("votes").to_numpy(), m), b.column("n").to_numpy()
            p = 1 / (1 + np.exp(-np.clip(model.logit(x), -500, 500)))
            for k, w in enumerate((n * (1 - p), n * p)):
                total[k, :-1] += ((x * w[:, None]).T @ x).reshape(-1) if pairs else w @ x
                total[k, -1] += w.sum()
        keys = np.arange(total.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[0]), pa.array(total[1])], names=["k", "clean", "toxic"])

    return run


def _summed(votes: DataFrame, model: LabelModel, pairs: bool = False) -> np.ndarray:
    rows = votes.mapInArrow(_moments(model, pairs), "k int, clean double, toxic double").groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas().sort_values("k")
    out = rows[["clean", "toxic"]].to_numpy().T
    return out if out.size else np.zeros((2, (len(model.fires) ** 2 if pairs else len(model.fires)) + 1))


def label_model(votes: DataFrame, seen: np.ndarray, labels: np.ndarray, toxic: float, voters: int) -> LabelModel:
    """votes: distinct vote masks and their number n, of all learnable texts. seen: votes of labelled texts."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if n1 and n0:
        on1, on0 = seen[labels == 1].sum(0), seen[labels == 0].sum(0)
    else:
        n1, n0 = 100, 100
        on1, on0 = np.full(voters, FIRES * n1), np.full(voters, MISFIRES * n0)
    model = LabelModel((on1 + 0.5) / (n1 + 1), (on0 + 0.1) / (n0 + 1), toxic)
    for _ in range(2):  # the second time with the voters' parts known
        model = _maximised(votes, model, on1, on0, n1, n0)
        model.part = _parts(_summed(votes, model, pairs=True), voters)
    return model


def _maximised(votes: DataFrame, model: LabelModel, on1: np.ndarray, on0: np.ndarray, n1: int, n0: int) -> LabelModel:
    """STEPS rounds of expectation maximisation; what the labels show counts as much as what is hidden."""
    for _ in range(STEPS):
        clean, bad = _summed(votes, model)
        k1, k0 = max(1.0, bad[-1] / n1), max(1.0, clean[-1] / n0)
        new = LabelModel((bad[:-1] + k1 * (on1 + 0.5)) / (bad[-1] + k1 * (n1 + 1)), (clean[:-1] + k0 * (on0 + 0.1)) / (clean[-1] + k0 * (n0 + 1)), model.toxic)
        new.part = model.part
        done = np.abs(new.fires - model.fires).max() < 1e-3
        model = new
        if done:
            break
    return model


def _parts(both: np.ndarray, voters: int) -> np.ndarray:
    """1 over 1 plus a voter's correlations with the others, given the hidden label."""
    shared = np.zeros((voters, voters))
    for k, n in enumerate(both[:, -1]):
        if n > 1:
            joint = both[k, :-1].reshape(voters, voters) / n
            mean = np.diag(joint)
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
            shared = np.maximum(shared, (joint - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(shared, 0)
    return 1 / (1 + np.maximum(shared, 0).sum(1))


def _pick_voters(x: np.ndarray, g2: np.ndarray, most: int) -> list[int]:
    """The best features, leaving out those that occur almost where a better one does."""
    out: list[int] = []
    for i in np.argsort(-g2, kind="stable"):
        n = x[:, i].sum()
        if len(out) < most and (not out or not n or (x[:, out] & x[:, [i]]).sum(0).max() < 0.9 * n):
            out.append(int(i))
    return out


def _train(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights and, last, bias of a logistic regression on soft targets, by gradient steps scaled per feature."""
    w, seen, weight = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, 1e-8), weight / weight.sum()
    w[-1] = np.log(max(1e-6, (weight * target).sum()) / max(1e-6, (weight * (1 - target)).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))
        r = weight * (p - target)
        g = np.r_[r @ x, r.sum()]
        g[:-1] += l2 * w[:-1] / len(x) ** 0.5
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


class Classifier:
    def __init__(self, vocabulary: list[str], weights: np.ndarray) -> None:
        self.vocabulary, self.weights = vocabulary, weights


def _low(most: int, n: int) -> Column:
    """Below this place stand about 1.2 times most of n ids, or all if there are not so many."""
    return F.lit(min(PLACES, int(PLACES * 1.2 * most / max(1, n)) + 1)).cast("bigint")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Classifier:
    """docs: doc_id, text; labels: doc_id, toxic. Several labels of a document: their majority, toxic on a tie."""
    given = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    learnable = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    number = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = number.get(1, 0) / max(1, sum(number.values())) if len(number) == 2 else TOXIC
    # ids are told apart by a hash; only those low enough to be among the first SAMPLE are ranked
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    low = F.when(F.col("y") == 1, _low(SAMPLE[1], number.get(1, 0))).otherwise(_low(SAMPLE[0], number.get(0, 0)))
    order = Window.partitionBy("y").orderBy("place", "doc_id")
    picked = given.withColumn("place", place).filter(F.col("place") < low).withColumn("r", F.row_number().over(order)).filter((F.col("r") <= SAMPLE[0]) & ((F.col("y") == 0) | (F.col("r") <= SAMPLE[1]))).select("doc_id", "y")
    # an id on many rows counts once, with its least text
    sample = learnable.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = written(sample.select("text", "y"), "toxicity-sample")  # SAMPLE rows
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    mined = []
    if n1 and n0:
        cell = lambda x, side, row: F.when(x > 0, x * F.log(x * (n1 + n0) / (side * row))).otherwise(0.0)
        off = F.lit(n1 + n0) - a - b
        g2 = 2 * (cell(a, F.lit(n1), a + b) + cell(b, F.lit(n0), a + b) + cell(n1 - a, F.lit(n1), off) + cell(n0 - b, F.lit(n0), off))
        counts = sample.mapInArrow(_counts, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        mined = counts.filter(a * n0 > b * n1).withColumn("g2", g2).filter(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(VOCABULARY - len(LEXICON)).collect()
    strength = {r["feature"]: r["g2"] for r in mined}
    vocabulary = [*strength, *(f for w in LEXICON if (f := f"={w}") not in strength)]
    rows = sample.mapInArrow(_present(vocabulary), "y int, ids array<int>").collect()  # SAMPLE rows
    x = np.zeros((len(rows), len(vocabulary)), bool)
    for i, r in enumerate(rows):
        x[i, r["ids"]] = True
    y = np.array([r["y"] for r in rows], int)
    voters = _pick_voters(x, np.array([strength.get(f, 1.0) for f in vocabulary]), VOTERS)
    votes = written(learnable.select("text").mapInArrow(_votes([vocabulary[i] for i in voters]), "votes bigint").groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "toxicity-votes")
    model = label_model(votes, x[:, voters], y, toxic, len(voters))
    if not (n1 and n0):
        weights = np.zeros(len(vocabulary) + 1)
        weights[voters] = np.log(model.fires / model.misfires)
        weights[-1] = np.log(toxic / (1 - toxic))
        return Classifier(vocabulary, weights)
    said = model.logit(x[:, voters].astype(float)) + np.where(y == 1, GOLD, -GOLD)
    weight = np.where(y == 1, toxic / n1, (1 - toxic) / n0)
    return Classifier(vocabulary, _train(x.astype(np.float32), 1 / (1 + np.exp(-np.clip(said, -50, 50))), weight))


def _score(shared, columns: list[str], into: str) -> Callable[[Batches], Batches]:
    def run(parts: Batches) -> Batches:
        model = shared.value
        read, weights, bias = Reader(model.vocabulary), model.weights[:-1].tolist(), float(model.weights[-1])
        for b in parts:
            z = np.array([bias + sum(weights[i] for i in sorted(read(t))) for t in _texts(b)])
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(score, pa.float64())], names=[*columns, into])

    return run


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, into: str = "score") -> DataFrame:
    """The rows of docs (doc_id, text, ...) with into, from 0 to 1: how likely the text is toxic. A column of docs named
    like into is replaced. Null and empty texts get the score of a text without any known feature. Very long texts are scored whole. Without labels
    the lexicon decides alone. Repeated rows are scored alike. Empty table: no rows."""
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels))
    own = docs.drop(into)
    return own.mapInArrow(_score(shared, own.columns, into), T.StructType([*own.schema.fields, T.StructField(into, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
