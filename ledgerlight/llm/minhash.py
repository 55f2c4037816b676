"""Near-duplicate detection by weighted MinHash with darts.

A document is a weighted set of five-word shingles; a shingle's weight is how often it occurs. Darts fall on the
regions of its elements (one unit slab for each unit of weight) as a hashed Poisson process over time, the
same for every document; each dart belongs to one coordinate, and a coordinate keeps its earliest dart. Two
documents keep the same dart with the probability of their weighted Jaccard similarity. A document of weight N is
watched until time K (ln K + SLACK) / N, so a signature takes about K ln K darts however long the text is.

Bands of the signature find candidates; whole shingle sets decide. Texts that share a bucket, and so on through
others, are one group: the connected components of the buckets. All links lie inside the groups, so a group is settled
where it stands: one task holds its sketches and compressed texts, goes through it from the most central text on, and
verifies pairs of likely sketches that are not connected yet, the likeliest first. A group of mutual near copies
takes one verification a text and no pair leaves the task. A group over GROUP_TEXTS or GROUP_BYTES is not given to one task: see wide().
Copies of one text are one node throughout. Classes are connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm import words as W
from ledgerlight.llm.components import components
from ledgerlight.llm.workspace import written

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 all bands miss with probability (1 - 0.8**8)**40 = 0.0006; at 0.85, 0.000004. Texts that share
#: a third of their shingles meet in a band with probability 0.006.
BANDS, BAND_ROWS = 40, 8
SLACK = 5.0
#: The most that one task settles: texts of a group, and their bytes.
GROUP_TEXTS, GROUP_BYTES = 8192, 48 << 20
#: In a wider group: leaders that a part gets in a round, and texts of a part that are held against them together.
LEADERS, PART_ROWS = 64, 4096
#: Pairs are verified whose sketches (8 bits of each of 320 coordinates) agree in similarity - MARGIN of the coordinates. At
#: similarity 0.8 that is 4 standard deviations below: fewer are missed by that than share no band.
MARGIN = 0.09
_SLAB, _ARRIVAL, _DART = W.U(0xA0761D6478BD642F), W.U(0xE7037ED1A0B428DB), W.U(0x8EBC6AF09C88C6E3)


def weighted(words: W.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Element and text of each unit slab: equal shingles of a text get slabs 0, 1, ..."""
    h, _, doc = words.windows(k, short=True)
    if not len(h):
        return h, doc
    own = W.mix(h ^ W.mix(doc.astype(W.U)))
    order = np.argsort(own, kind="stable")
    s = own[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    nth = np.empty(len(h), np.int64)
    nth[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
    return W.mix(h + nth.astype(W.U) * _SLAB), doc


def _throw(base: np.ndarray, at: np.ndarray | int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next dart on each slab: its hash and its time."""
    x = W.mix(base + np.asarray(at).astype(W.U) * _ARRIVAL)
    return W.mix(x ^ _DART), rank - np.log1p((x >> W.U(11)) * -(2.0**-53))


def _keep(sig: np.ndarray, doc: np.ndarray, dart: np.ndarray, time: np.ndarray) -> None:
    """Keeps the earliest dart of each coordinate: time in the high bits, the dart's hash in the low ones."""
    k = sig.shape[1]
    coordinate = ((dart >> W.U(32)) * W.U(k)) >> W.U(32)
    value = (time.astype(np.float32).view(np.uint32).astype(W.U) << W.U(32)) | (dart & W.U(0xFFFFFFFF))
    np.minimum.at(sig.reshape(-1), doc * k + coordinate.astype(np.int64), value)


def signatures(words: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of k coordinates for each text, and its weight. A text without words has no darts."""
    base, doc = weighted(words)
    n = len(words.counts)
    weight = np.bincount(doc, minlength=n)
    sig = np.full((n, k), ~W.U(0))
    until = k * (math.log(k) + SLACK) / np.maximum(weight, 1)
    if not len(base):
        return sig, weight
    few = until > 8  # short texts: many darts on each slab, thrown at once
    ends = np.cumsum(weight)
    for d in np.flatnonzero(few & (weight > 0)):
        mine = base[ends[d] - weight[d] : ends[d]]
        m = int(until[d] + 6 * math.sqrt(until[d]) + 10)
        x = W.mix(mine[:, None] + np.arange(m, dtype=W.U)[None, :] * _ARRIVAL)
        time = np.cumsum(-np.log1p((x >> W.U(11)) * -(2.0**-53)), axis=1)
        hit = time < until[d]
        _keep(sig, np.full(int(hit.sum()), d), W.mix(x[hit] ^ _DART), time[hit])
    live = ~few[doc]
    base, doc = base[live], doc[live]
    rank, limit, nth = np.zeros(len(base)), until[doc], 0
    while len(base):
        dart, rank = _throw(base, nth, rank)
        hit = rank < limit
        base, doc, rank, limit = base[hit], doc[hit], rank[hit], limit[hit]
        _keep(sig, doc, dart[hit], rank)
        nth += 1
    return sig, weight


def _sign(bands: int, rows: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys, weights, sketches = [], [], []
            for _, _, words in W.batches(b.column("text")):
                sig, weight = signatures(words, bands * rows)
                out = np.zeros((len(sig), bands), W.U)
                for j in range(rows):
                    out = W.mix(out + sig[:, j::rows] + W.U(j + 1))
                out = W.mix(out + np.arange(1, bands + 1, dtype=W.U) * _SLAB)
                keys += [r if w else None for r, w in zip(W.as_signed(out), weight, strict=True)]
                weights += weight.tolist()
                sketches += [r.tobytes() for r in (sig & W.U(0xFF)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(weights, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "th", "weight", "bands", "sketch"])

    return run


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for b in parts:
        data, at = W.buffers(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(np.diff(at)), pa.array([z.compress(data[at[i] : at[i + 1]]) for i in range(len(at) - 1)], pa.binary())], names=["th", "size", "packed"])


def _slabs(packed: bytes) -> np.ndarray:
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.sort(weighted(W.Words(text, np.array([0, len(text)])))[0])


def _similarity(mine: np.ndarray, other: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted lists of unit slabs."""
    both = len(np.intersect1d(mine, other, assume_unique=True))
    return both / max(1, len(mine) + len(other) - both)


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, mine = None, None
    for b in parts:
        sims = []
        for a, pa_, pb_ in zip(b.column("a").to_pylist(), b.column("packed_a"), b.column("packed_b"), strict=True):
            if a != last:
                last, mine = a, _slabs(pa_.as_py())
            sims.append(_similarity(mine, _slabs(pb_.as_py())))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def _judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with sim, from the whole texts."""
    left = texts.select(F.col("th").alias("b"), F.col("packed").alias("packed_b"))
    right = texts.select(F.col("th").alias("a"), F.col("packed").alias("packed_a"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "packed_a", "packed_b")
    return both.mapInArrow(_verify, "a bigint, b bigint, sim double")


def _resolve(least: float, similarity: float):
    """Rows th, sketch, packed in the order of their groups: th and the least th of its class, group by group."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in parts:
            group = b.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and held[0].column("group")[0].as_py() != group[i]:
                    yield _settled(held, least, similarity)
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield _settled(held, least, similarity)

    return run


def _settled(rows: list[pa.RecordBatch], least: float, similarity: float) -> pa.RecordBatch:
    """The classes of one group. label: of each text, the class so far."""
    th = np.concatenate([b.column("th").to_numpy() for b in rows])
    sketch = np.stack([np.frombuffer(x.as_py(), np.uint8) for b in rows for x in b.column("sketch")])
    packed = [x for b in rows for x in b.column("packed")]
    n, k = sketch.shape
    shared = np.zeros(n, np.int64)
    for c in range(k if n > 2 else 0):  # a text that agrees with many is central
        shared += np.bincount(sketch[:, c], minlength=256)[sketch[:, c]]
    order = np.lexsort((th, -shared))
    th, sketch, packed = th[order], sketch[order], [packed[i] for i in order]
    slabs: list[np.ndarray | None] = [None] * n

    def of(i: int) -> np.ndarray:
        if slabs[i] is None:
            slabs[i] = _slabs(packed[i].as_py())
        return slabs[i]

    label = np.arange(n)
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        agree = (sketch[rest] == sketch[i]).sum(1)
        likely = agree >= least * k
        for j in rest[likely][np.argsort(-agree[likely], kind="stable")].tolist():
            if label[j] != label[i] and _similarity(of(i), of(j)) >= similarity:
                label[label == label[j]] = label[i]
        slabs[i] = None  # no later text is held against this one
    root = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(root, label, th)
    return pa.RecordBatch.from_arrays([pa.array(th), pa.array(root[label])], names=["th", "root"])


def roots(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS) -> tuple[DataFrame, DataFrame]:
    """doc_id, th (hash of the text) of every row of docs (doc_id, text), and th, root of the texts that share a bucket with
    another: root is the least th of the class."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    signed = written(base.mapInArrow(_sign(bands, rows), "doc_id bigint, th bigint, weight bigint, bands array<bigint>, sketch binary"), "minhash-signed")
    members = signed.select(F.posexplode("bands").alias("band", "bucket"), "th", "weight")
    ends = members.groupBy("bucket").agg(F.min("th").alias("c"), F.max("th").alias("top")).filter("c < top").select("bucket", "c")
    grouped = components(members.join(ends, "bucket").filter("th <> c").select(F.col("th").alias("a"), F.col("c").alias("b")), "minhash-groups")
    grouped = grouped.select(F.col("node").alias("th"), F.col("root").alias("group"))
    # merged at every size: a small input takes the plan that a large one needs
    grouped = grouped.hint("merge")
    sketches = signed.groupBy("th").agg(F.first("sketch").alias("sketch"))
    texts = base.select("th", "text").mapInArrow(_pack, "th bigint, size bigint, packed binary").join(grouped, "th", "left_semi").groupBy("th").agg(F.first("size").alias("size"), F.first("packed").alias("packed"))
    held = written(sketches.join(grouped, "th").join(texts.hint("merge"), "th"), "minhash-held")
    over = held.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter((F.col("n") > GROUP_TEXTS) | (F.col("bytes") > GROUP_BYTES)).select("group")
    over = written(over, "minhash-over")
    wider = not over.isEmpty()
    small = held.join(over, "group", "left_anti") if wider else held
    settled = small.select("group", "th", "sketch", "packed").repartition("group").sortWithinPartitions("group", "th")
    found = settled.mapInArrow(_resolve(similarity - MARGIN, similarity), "th bigint, root bigint")
    if wider:
        wide_ = held.join(over, "group", "left_semi").select("th", "sketch", "packed")
        found = found.unionByName(wide(spark, members.join(wide_.select("th"), "th", "left_semi"), wide_, similarity, rows))
    return signed.select("doc_id", "th"), found


def classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, th (hash of the text), class_root (least th of the class), class_id, class_size for every row of docs
    (doc_id, text; more columns are left out). class_id: the least doc_id of the class; null if no row of it has one. Equal texts, null and empty
    ones among them (null counts as empty), are one class; a text without words is like no other text. Texts
    under five words have one shingle, all their words. A very long text is signed whole, in memory proportional to its length. Repeated rows are
    rows like any other. Empty table: no rows. Two texts of the same 64-bit hash would be taken for equal."""
    keyed, found = roots(spark, docs, similarity, bands, rows)
    placed = written(keyed.join(found, "th", "left").withColumn("root", F.coalesce("root", "th")), "minhash-placed")
    size = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(size, "root").select("doc_id", "th", F.col("root").alias("class_root"), "class_id", "class_size")


def wide(spark: SparkSession, members: DataFrame, held: DataFrame, similarity: float, band_rows: int) -> DataFrame:
    """th, root of the texts of groups that no one task may hold. members: band, bucket, th, weight; held: th, sketch, packed.
    A bucket is split by weight, as similar texts have similar weights. In each part every text is held against the
    most central one. Then, round by round, components of the links so far are formed; in a part that holds several,
    texts outside its largest one become leaders, some each round, and are held against the part's texts of
    other components, in blocks of bounded size, until no two texts of different classes share a part unseen."""
    size = F.floor(F.log("weight") / F.lit(max(1e-6, -math.log(similarity))) + 1e-9).cast("int")
    members = members.groupBy("bucket", "th").agg(F.first("weight").alias("weight"), F.first("band").alias("band")).withColumn("size", size)
    # a text that shares its buckets with many is central: near copies of one base are most like that one
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    central = members.join(full, "bucket").groupBy("th").agg(F.sum("n").alias("shared"))
    members = members.join(central, "th").select(F.explode(F.array("size", F.col("size") + 1)).alias("part"), "bucket", "band", "th", "size", "shared")
    members = members.select(F.xxhash64("bucket", "part").alias("part"), "band", "th", (F.col("part") == F.col("size")).alias("upper"), "shared")
    center = members.groupBy("part").agg(F.max(F.struct("shared", "th")).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("part", F.col("c.th").alias("c"))
    members = written(members.join(center, "part"), "minhash-members")
    texts, sketches = held.select("th", "packed"), held.select("th", "sketch")
    pairs = members.filter("th <> c").select(F.least("c", "th").alias("a"), F.greatest("c", "th").alias("b")).distinct()
    done = members.filter("th = c").select("part", "th")
    seen: DataFrame | None = None
    roots = spark.createDataFrame([], "th bigint, root bigint")
    while True:
        judged = written(_judged(pairs, texts), "minhash-judged")
        seen = judged.select("a", "b") if seen is None else written(seen.unionByName(judged.select("a", "b")), "minhash-seen")
        links = judged.filter(F.col("sim") >= similarity).select("a", "b").unionByName(roots.select(F.col("th").alias("a"), F.col("root").alias("b")))
        roots = components(links, "minhash-components").select(F.col("node").alias("th"), "root")
        rooted = written(members.select("part", "band", "th", "upper", "shared").join(roots, "th", "left").withColumn("root", F.coalesce("root", "th")), "minhash-rooted")
        mixed = rooted.groupBy("part", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("part", F.col("top.root").alias("most"))
        open_ = written(rooted.join(mixed, "part").filter("root <> most").join(done, ["part", "th"], "left_anti").drop("most"), "minhash-open")
        if open_.isEmpty():
            return roots
        rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("shared"), "th"))
        lead = written(open_.withColumn("r", rank).filter(F.col("r") <= LEADERS).drop("r"), "minhash-leaders")
        done = written(done.unionByName(lead.select("part", "th")), "minhash-done")
        pairs = _meeting(rooted, lead, sketches, similarity - MARGIN, band_rows).distinct().join(seen, ["a", "b"], "left_anti")


def _meeting(rooted: DataFrame, lead: DataFrame, sketches: DataFrame, least: float, band_rows: int) -> DataFrame:
    """Pairs a, b of a leader and a text of its part, of different components, whose sketches agree in so many
    coordinates; each pair in its first common band only. Parts are dealt out in blocks of bounded size."""
    size = rooted.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("blocks")).join(lead.select("part").distinct(), "part", "left_semi")
    columns = ["part", "band", "th", "root", "upper"]
    mine = rooted.join(size, "part").select(*columns, F.pmod(F.xxhash64("th"), "blocks").alias("block"), F.lit(False).alias("leads"))
    theirs = lead.join(size, "part").select(*columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("leads"))
    rows = written(mine.unionByName(theirs), "minhash-meeting")
    dealt = F.pmod(F.xxhash64("part", "block"), F.lit(1 + rows.count() // PART_ROWS)).alias("dealt")
    return rows.join(sketches, "th").select(dealt, "block", *columns, "leads", "sketch").groupBy("dealt").applyInArrow(_likely(least, band_rows), "a bigint, b bigint")


def _likely(least: float, band_rows: int):
    def run(rows: pa.Table) -> pa.Table:
        part, block, leads = rows["part"].to_numpy(), rows["block"].to_numpy(), rows["leads"].to_numpy()
        order = np.lexsort((~leads, block, part))
        part, block, leads = part[order], block[order], leads[order]
        th, root, upper, band = (rows[c].to_numpy()[order] for c in ("th", "root", "upper", "band"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(part), -1)[order]
        k = sketch.shape[1]
        first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (block[1:] != block[:-1])])
        found = [np.zeros((0, 2), np.int64)]
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
            m = i + int(leads[i:j].sum())
            for x in range(i, m):
                rest = np.arange(m, j)[(root[m:j] != root[x]) & (upper[m:j] | upper[x])]
                same = sketch[rest] == sketch[x]
                near = same.sum(1) >= least * k
                rest, same = rest[near], same[near]
                common = same.reshape(len(same), k // band_rows, band_rows).all(2).argmax(1)
                rest = rest[common == band[x]]
                found.append(np.sort(np.stack([np.full(len(rest), th[x]), th[rest]], 1), axis=1))
        pairs = np.concatenate(found)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("th", "class_root")


def deduplicated(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with their columns, of which one of each class stays: the one with the least doc_id (a missing
    one last), then with the least hash of all its columns; of fully repeated rows one. Null and empty texts are
    one class. Rows of equal 64-bit hash of all columns are taken for equal. Empty table: no rows.

    Who stays is decided on ids and hashes; texts are shuffled once, by the hash of their row."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.xxhash64(*docs.columns).alias("row_hash"))
    _, found = roots(spark, docs.select("doc_id", "text"), similarity)
    placed = keyed.join(found, "th", "left").withColumn("root", F.coalesce("root", "th"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_hash")).alias("f")
    kept = written(placed.groupBy("root").agg(first).select(F.col("f.row_hash").alias("kept")), "minhash-kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("own"))
    return rows.join(kept, F.col("own") == F.col("kept"), "left_semi").dropDuplicates(["own"]).select("row.*")
