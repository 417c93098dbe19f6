"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Tokens are runs of letters, of digits and of other marks, hashed to `BUCKETS` rows. Every
row has a fixed sparse index vector of +1 and -1. The context vector of a row is the sum
of the index vectors of all tokens within `REACH` places of its occurrences, over the
whole corpus and without any label: tasks sum integers, Spark adds them up, and a table of
fixed size reaches the driver. A word vector is the context vector, centred and scaled, plus the
index vector.

A document is the mean and the standard deviation of its tokens' vectors, the mean
products of neighbouring vectors and the logarithm of its length. A
two-layer network in numpy learns quality from a bounded sample of labelled rows (at most
`TRAIN_DOCS`, chosen by a hash of the id); a fifth of the sample sets the temperature
that turns its output into a probability.

Defined results: null and empty texts pool to zeros and get a score like any other. Several
labels of one id count by their mean; null labels are ignored. With labels of one kind
only, or none, every score is the smoothed share of label 1. Repeated rows are scored
each. Very long texts are pooled in blocks, whole. An empty table has no rows. Extra columns are kept out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name

BITS = 14
BUCKETS = 1 << BITS
DIMENSIONS = 32
NONZERO = 4
REACH = 2
BLOCK = 1 << 16
WIDTH = 2 * DIMENSIONS + 3
HIDDEN = 32
TRAIN_DOCS = 8000
EPOCHS = 60
MINIBATCH = 128
LEARNING_RATE = 0.003
THRESHOLD = 0.7

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")


def token_rows(raw: bytes | None) -> np.ndarray:
    """The table rows of all tokens of a whole text."""
    tokens = _TOKEN.findall(raw or b"")
    return (np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens)) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """The fixed index vector of every row, and a row of zeros at the end."""
    rng = np.random.default_rng(11)
    table = np.zeros((BUCKETS + 1, DIMENSIONS), np.int32)
    places = rng.permuted(np.tile(np.arange(DIMENSIONS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    table[np.arange(BUCKETS)[:, None], places] = rng.choice((-1, 1), (BUCKETS, NONZERO))
    return table


class ContextSums:
    """Context vectors of one task, summed in integers."""

    def __init__(self):
        self.sums, self.seen = np.zeros((BUCKETS + 1, DIMENSIONS), np.int64), np.zeros(BUCKETS + 1, np.int64)
        self.waiting, self.size = [], 0

    def add(self, rows: np.ndarray) -> None:
        # Zeros behind every text keep contexts inside it.
        self.waiting += [rows, np.full(REACH, BUCKETS, np.int64)]
        self.size += len(rows) + REACH
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        rows, index = np.concatenate(self.waiting), index_vectors()
        for start in range(0, len(rows), BLOCK):
            low, high = max(0, start - REACH), min(len(rows), start + BLOCK + REACH)
            near = index[rows[low:high]]
            around = np.zeros_like(near)
            for k in range(1, REACH + 1):
                around[k:] += near[:-k]
                around[:-k] += near[k:]
            own = slice(start - low, min(start + BLOCK, len(rows)) - low)
            block = rows[low:high][own]
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.diff(block[order], prepend=-1))
            self.sums[block[order][first]] += np.add.reduceat(around[own][order], first, axis=0)
            self.seen += np.bincount(block, minlength=BUCKETS + 1)
        self.waiting, self.size = [], 0

    def batch(self) -> pa.RecordBatch:
        self.flush()
        rows = np.flatnonzero(self.seen[:BUCKETS])
        columns = {"bucket": rows, "seen": self.seen[rows]} | {f"c{k}": self.sums[rows, k] for k in range(DIMENSIONS)}
        return pa.RecordBatch.from_pydict(columns)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all rows, from the contexts in all texts of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = ContextSums()
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                sums.add(token_rows(raw))
        yield sums.batch()

    names = ["seen", *(f"c{k}" for k in range(DIMENSIONS))]
    schema = "bucket long, " + ", ".join(f"{n} long" for n in names)
    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, schema)
    table = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    rows = table.column("bucket").to_numpy()
    seen, sums = np.zeros(BUCKETS), np.zeros((BUCKETS, DIMENSIONS))
    seen[rows] = table.column("seen").to_numpy()
    for k in range(DIMENSIONS):
        sums[rows, k] = table.column(f"c{k}").to_numpy()
    centre = sums.sum(axis=0) / max(1.0, seen.sum())
    context = np.where(seen[:, None] > 0, sums / np.maximum(seen, 1)[:, None] - centre, 0)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return (context + index_vectors()[:BUCKETS] / np.sqrt(NONZERO)).astype(np.float32)


def pooled(raw: bytes | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the vectors of all tokens, the mean products of
    tokens one and two places apart (high where words repeat), and the logarithmic length."""
    rows = token_rows(raw)
    n = max(1, len(rows))
    total, squares, near = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(2)
    for start in range(0, len(rows), BLOCK):
        part = vectors[rows[start : start + BLOCK + 2]]
        for k in (1, 2):
            near[k - 1] += np.einsum("ij,ij->", part[:BLOCK][: len(part) - k], part[k : BLOCK + k])
        part = part[:BLOCK]
        total += part.sum(axis=0, dtype=np.float64)
        squares += np.einsum("ij,ij->j", part, part)
    mean = total / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), near / n, [np.log1p(len(rows))]])


@dataclass(frozen=True)
class QualityModel:
    """Two layers over scaled features; `scale` divides the output by the temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float
    # Share of label 1 where there is nothing to learn.
    constant: float | None = None

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        inner = np.tanh((features - self.mean) / self.spread @ self.hidden + self.hidden_bias)
        return sigmoid((inner @ self.out + self.out_bias) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> QualityModel:
    """Adam on the logistic loss, then the temperature on every fifth row."""
    width, rng = WIDTH, np.random.default_rng(5)
    nothing = np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors, *nothing, constant=float((y.sum() + 1) / (len(y) + 2)))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    check = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    rows = np.flatnonzero(~check)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(rows)
        for start in range(0, len(order), MINIBATCH):
            xb, yb = x[order[start : start + MINIBATCH]], y[order[start : start + MINIBATCH]]
            inner = np.tanh(xb @ p[0] + p[1])
            slope = (sigmoid(inner @ p[2] + p[3]) - yb) / len(yb)
            back = np.outer(slope, p[2]) * (1 - inner * inner)
            grads = [xb.T @ back + 1e-4 * p[0], back.sum(axis=0), inner.T @ slope + 1e-4 * p[2], slope.sum(keepdims=True)]
            step += 1
            for v, g, m, s in zip(p, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= LEARNING_RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    judged = np.flatnonzero(check) if check.any() else rows
    logits = np.tanh(x[judged] @ p[0] + p[1]) @ p[2] + p[3]

    def loss(t: float) -> float:
        q = np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)
        return float(-(y[judged] * np.log(q) + (1 - y[judged]) * np.log(1 - q)).mean())

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0), key=loss)
    return QualityModel(vectors, mean, spread, p[0], p[1], p[2], float(p[3][0]), temperature)


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, train_docs: int = TRAIN_DOCS) -> QualityModel:
    """Fit on at most `train_docs` ids of `labels` (doc_id, quality) that `docs` (doc_id, text) has."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    # Ids are taken by their hash; those far beyond the last one wanted are left out before any are gathered.
    rate = 2 * train_docs / max(1, marks.count())
    near = marks if rate >= 0.5 else marks.filter(F.xxhash64("doc_id") < int((rate - 0.5) * 2.0**64))
    drawn = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([pooled(raw, shared.value).tobytes() for raw in texts.cast(pa.binary()).to_pylist()], pa.binary())

    found = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "good", features(F.col("text").cast("string")).alias("x"))
    rows = found.groupBy("doc_id").agg(F.first("good").alias("good"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), WIDTH)
    return fit(x, np.array([float(r["good"]) for r in rows]), vectors)


SCORED = pa.struct([("score", pa.float64()), ("predicted", pa.int32())])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 from `threshold` on) per row of `docs`."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "scored")

    @F.arrow_udf("struct<score: double, predicted: int>")
    def score(texts: pa.Array) -> pa.Array:
        own = shared.value
        x = np.array([pooled(raw, own.vectors) for raw in texts.cast(pa.binary()).to_pylist()]).reshape(len(texts), WIDTH)
        scores = own.scores(x)
        return pa.StructArray.from_arrays([pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], fields=list(SCORED))

    return docs.select("doc_id", score(F.col("text").cast("string")).alias(name)).select("doc_id", f"{name}.*")
