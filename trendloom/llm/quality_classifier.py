"""Operator 6: a quality classifier of supervised subword embeddings.

A document is the average of learned vectors of its hashed features: words, word pairs (a word followed by itself is
one feature of its own), and the 3- to 5-character n-grams of words with their borders. A softmax layer over the average
gives the two classes. Vectors and layer are trained together by numpy stochastic gradient descent on a bounded sample:
at most `MAX_TRAIN` labelled documents with the smallest hash of their id, whole texts, and of these as many as have
`MAX_FEATURES` different features in all (a document has at most 2^18). Features are hashed and counted in tasks; the
driver gets numbers, no texts. Since the layer is linear, a trained feature is one number at scoring time; every task
sums these numbers over whole texts, half a million characters at a time, whatever the length of a document: a long
text is cut between words, and the word before a cut is read again with what follows, so no pair is lost.

Defined cases: null, empty and blank texts have no features and score by the bias alone; labels that are null, or that
contradict each other for one doc_id, are not learned; of rows that share a labelled doc_id one is learned from;
without labels of both classes every score is the smoothed share of good labels (0.5 without any); an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import give_back, stash
from trendloom.llm.encode import slices

BUCKET_BITS = 18
DIM, RATE, BATCH = 8, 4.0, 16
#: Gradient steps aimed at; small samples are gone through more often.
STEPS, EPOCHS = 1000, (3, 60)
MAX_TRAIN, MAX_FEATURES = 1200, 12_000_000
#: Characters hashed at once.
PART = 1 << 19
GRAMS = (3, 4, 5)
THRESHOLD = 0.3
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
PAIR_OF_SAME = 1


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x632BE59BD9B4E019 % 2**64)) * M2
    h ^= h >> np.uint64(32)
    return ((h * M1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


#: An odd base of polynomial hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word from all its characters: differences of one running polynomial, shifted to a common place."""
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(data), BASE, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(data), INVERSE, np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])]
    h = (total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)
    h ^= h >> np.uint64(29)
    return h * M1


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def _spaces(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def hashed_features(parts: list[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(part, bucket) arrays of all features of parts, kind by kind. A part is characters and how many of the first are
    only there for the pair with what follows."""
    gap = np.array([32], np.uint32)
    data = np.concatenate([gap, *(x for codes, _ in parts for x in (codes, gap))])
    space = _spaces(data)
    data[space] = 32
    length = np.array([len(codes) + 1 for codes, _ in parts], np.int64)
    first = 1 + np.cumsum(length) - length + np.array([skip for _, skip in parts], np.int64)
    owner = np.r_[np.int32(0), np.repeat(np.arange(len(parts), dtype=np.int32), length)]
    step = np.diff(space.astype(np.int8))
    start, end = np.flatnonzero(step == -1) + 1, np.flatnonzero(step == 1) + 1
    if not len(start):
        return
    word, doc = _word_hashes(data, start, end), owner[start]
    fresh = start >= first[doc]
    yield doc[fresh], _bucket(word[fresh], 1)
    pair = (doc[1:] == doc[:-1]) & fresh[1:]
    same = word[1:] == word[:-1]
    both = np.where(same, np.uint64(PAIR_OF_SAME), word[:-1] * M2 + word[1:] * np.uint64(3))
    yield doc[1:][pair], _bucket(both[pair], 2)
    count = np.cumsum(space, dtype=np.int32)
    h = data.astype(np.uint64)
    made = 1
    for n in GRAMS:
        while made < n:
            h = h[:-1] * np.uint64(0x100000001B3) + data[made:].astype(np.uint64)
            made += 1
        if not len(h):
            return
        inside = count[n - 2 : len(data) - 1] == count[: len(data) - n + 1]  # no space strictly inside: counts up to the second last and the first character
        at = np.flatnonzero(inside[: len(h)] & ~space[1 : len(h) + 1])
        at = at[at + 1 >= first[owner[at + 1]]]
        yield owner[at + 1], _bucket(h[at], n)


def _cut(text: bytes, part: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """A text in parts of about `part` characters, cut between words; each begins with the last word of the one before."""
    part = part or PART
    codes = _codes(text)
    if len(codes) <= part:
        yield codes, 0
        return
    gaps = np.flatnonzero(_spaces(codes))
    at = skip = 0
    while at + skip < len(codes):
        limit = at + skip + part
        k = int(np.searchsorted(gaps, limit))
        if limit >= len(codes):
            end = len(codes)
        elif k and gaps[k - 1] > at + skip:
            end = int(gaps[k - 1])
        else:  # a word longer than a part stays whole
            end = int(gaps[k]) if k < len(gaps) else len(codes)
        yield codes[at:end], skip
        letters = np.flatnonzero(~_spaces(codes[at:end]))
        if not len(letters):
            at, skip = end, 0
            continue
        before = int(np.searchsorted(gaps, at + letters[-1]))
        word = max(at, int(gaps[before - 1]) + 1 if before else 0)
        at, skip = word, end - word


@dataclass
class Model:
    """What scoring needs: a number per feature bucket and the bias, both as log odds of the good class."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        parts: list[tuple[np.ndarray, int]] = []
        owner: list[int] = []
        held = 0

        def flush():
            nonlocal held
            own = np.array(owner, np.int64)
            for doc, bucket in hashed_features(parts):
                np.add.at(total, own, np.bincount(doc, self.weight[bucket], len(parts)))
                np.add.at(n, own, np.bincount(doc, minlength=len(parts)))
            parts.clear()
            owner.clear()
            held = 0

        for i, t in enumerate(texts):
            for p in _cut(t):
                parts.append(p)
                owner.append(i)
                held += len(p[0])
                if held >= PART:
                    flush()
        if parts:
            flush()
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias)))


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text and the share of its features in each."""
    sums = np.zeros(1 << BUCKET_BITS, np.int64)
    for p in _cut(text):
        for _, bucket in hashed_features([p]):
            sums += np.bincount(bucket, minlength=len(sums))
    bucket = np.flatnonzero(sums)
    return bucket.astype(np.int32), (sums[bucket] / max(1, sums.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int | None = None, seed: int = 7) -> Model:
    """rows: buckets and shares of each document, as `counted` gives them."""
    buckets = 1 << BUCKET_BITS
    ones = float(good.sum())
    if not 0 < ones < len(good):
        return Model(np.zeros(buckets), float(np.log((ones + 1) / (len(good) - ones + 1))))
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (buckets, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2)), np.log(np.array([len(good) - ones, ones]) / len(good))
    label = np.stack([1 - good, good], 1).astype(float)
    batches = -(-len(rows) // BATCH)
    epochs = epochs or min(EPOCHS[1], max(EPOCHS[0], -(-STEPS // batches)))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = np.stack([v @ embed[c] for c, v in (rows[d] for d in docs)]).astype(float)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - label[docs]) / len(docs)
            back = error @ layer.T
            layer -= rate * hidden.T @ error
            bias -= 0.1 * rate * error.sum(0)
            for d, pull in zip(docs, (-rate * len(docs) * back).astype(np.float32)):
                c, v = rows[d]  # a bucket stands once in a row
                embed[c] += v[:, None] * pull
    seen = np.zeros(buckets, bool)
    for c, _ in rows:
        seen[c] = True  # a bucket that training never saw has no say
    weight = np.where(seen, embed @ (layer[:, 1] - layer[:, 0]), 0.0)
    return Model(weight, float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counted(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array([c for c, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["doc_id", "good", "buckets", "shares"])
    give_back()


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    """Learn labels.quality from at most max_train documents outside fold 0 with max_features different features in all."""
    known = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).filter("a = b")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select("doc_id", F.col("a").alias("good"))
    # The sample has a proven size, so it may be broadcast; the texts are not shuffled.
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stash(labelled.mapInArrow(_counted_rows, "doc_id long, good int, buckets array<int>, shares array<float>"), "features")
    one = F.min_by(F.struct("buckets", "shares", "good"), F.xxhash64("buckets", "shares"))
    sizes = rows.groupBy("doc_id").agg(F.max(F.size("buckets")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    within = np.cumsum([r.n for r in sizes]) <= max_features
    ids = [r.doc_id for r, ok in zip(sizes, within) if ok]
    got = rows.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(one.alias("one")).select("doc_id", "one.*").orderBy("doc_id").toArrow()
    column = lambda name: [np.asarray(x.values) for x in got[name].combine_chunks()] if len(got) else []
    return train(list(zip(column("buckets"), column("shares"))), np.asarray(got["good"]).astype(float))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, and the columns in `carry`."""
    where = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = where.value
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b.column(1), 8 * PART)):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts), pa.float64()), *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    kinds = "doc_id long, score double" + "".join(f", `c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, kinds).select("doc_id", "score", *(F.col(f"c_{c}").alias(c) for c in carry))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
