"""Language-model scoring: a log-bilinear neural model trained by noise contrast.

Every text is a row of tokens (words in lower case, then one end mark). The texts are
tokenised once into shards of about `SHARD_BYTES`; a shard holds its distinct words and
the texts as numbers. Counts of all words of all training texts are summed in Spark
and joined back shard by shard; no vocabulary of the corpus is ever in one place.

The neural model works on two levels. The first predicts one of the `WORDS` most frequent
words or "another word" from the two tokens before: vector = R[t-1] A + R[t-2] B, logit of
w = vector . Q[w] + b[w]. It is trained on all training tokens by parameter averaging: each
task runs stochastic gradient steps of the noise-contrastive loss over its shards in numpy,
Spark averages the parameters by tokens, once or for several `rounds`. For scoring, batched
matrix products give the exact normaliser of every distinct context.

The second level shares out "another word" among all other training words, however many.
The frequent words are clustered by their trained vectors, and every place of a text gets the
component for which the words around it vote. Each distinct word has a target row (how
often it stands at places of each component) and a context row (the same for the place that
follows it), summed over the corpus into a written table. A row stands for the shares of its components; the
shares of all words are put into a codebook by their two largest components and how large these are, and a
code means what its words have on average, so a word travels as its count and two codes in one
number. p(w | context) is the sum over components k of p(k | context codes of the two tokens before) *
(c(w) + SMOOTHING) * p(k | target code) / Z(k), where Z(k) is the sum over all
other words, one unseen word included, so the token probabilities of a context sum to one. The
context code of a word outside the frequent ones also moves its R away from the shared one. Contexts are
pairs of frequent words and codes, so they repeat within a shard, and the normalisers of both levels are worked out once for each.

Defined results: a null or empty text is a single end mark. Rows without an id belong to
training. Without training rows counts are zero and the model falls back to the base
score. Repeated rows are counted and scored each. Very long texts are a shard of their own, whole. An empty table
has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored, words_in

SHARD_BYTES = 8 << 20
WORDS = 1000
DIMENSIONS = 16
NOISE = 30
MINIBATCH = 4096
LEARNING_RATE = 0.3
ROUNDS = 2
SMOOTHING = 0.1
CONTEXTS_AT_ONCE = 2048
# A word is counted at first where a shard has it so often; candidates for each frequent word that are counted fully.
OFTEN, CANDIDATES = 3, 20
# Second level: components, places on each side that vote, pseudo-places of a row, weights of the two tokens before.
COMPONENTS = 8
WINDOW = 4
PRIOR = 0.5
NEAR, FAR = 1.0, 0.9
PLACES_AT_ONCE = 1 << 16
# Places of whole texts that vote at once.
VOTES_AT_ONCE = 1 << 18
# Pairs of contexts up to which they are numbered by a table instead of by sorting.
PAIRS_IN_TABLE = 1 << 24
# Steps of the largest and second largest share that tell codes apart; code 0 is a word without places.
TARGET_LEVELS = (0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
CONTEXT_LEVELS = (0.2, 0.3, 0.5, 0.7, 0.9)
# Bits of the codes in a packed word.
TARGET_BITS = CONTEXT_BITS = 13
# The end mark; no word is empty.
END = b""

SHARDS = "shard long, words array<binary>, n_train array<int>, tokens binary, doc_ids array<bigint>, held array<boolean>, lengths array<int>"
SHARDS_ARROW = pa.schema(
    [
        ("shard", pa.int64()), ("words", pa.list_(pa.binary())), ("n_train", pa.list_(pa.int32())), ("tokens", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
    ]
)


def tokens_of(raw: bytes | None) -> Iterator[bytes]:
    """Lower-case words and the end mark; bytes know only A-Z and the six ASCII white-space characters."""
    return chain(words_in((raw or b"").lower()), (END,))


def packed(numbers: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first, which compresses well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int32)


class Shard:
    """Texts of one shard as numbers of its own words."""

    def __init__(self, number: int):
        self.number, self.size, self.parts = number, 0, []
        self.doc_ids, self.held = [], []
        self.words: defaultdict[bytes, int] = defaultdict(lambda: len(self.words))

    def add(self, doc_id: int | None, held: bool, raw: bytes | None) -> None:
        self.parts.append(np.fromiter(map(self.words.__getitem__, tokens_of(raw)), np.int32))
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.size += len(raw or b"")

    def row(self) -> pa.RecordBatch:
        training = [p for p, held in zip(self.parts, self.held) if not held]
        counts = np.bincount(np.concatenate([*training, np.zeros(0, np.int32)]), minlength=len(self.words))
        values = [
            [self.number], [list(self.words)], [counts.astype(np.int32)], [packed(np.concatenate(self.parts))],
            [self.doc_ids], [self.held], [list(map(len, self.parts))],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, SHARDS_ARROW)], schema=SHARDS_ARROW)


def shard_rows(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    shard = Shard(number)
    for batch in batches:
        for doc_id, held, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            if shard.doc_ids and shard.size + len(raw or b"") > shard_bytes:
                yield shard.row()
                number += 1
                shard = Shard(number)
            shard.add(doc_id, held, raw)
    if shard.doc_ids:
        yield shard.row()


def build_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenise `docs` (doc_id, held_out, text) once into a written table, a shard a row group, as readers hold a whole one."""
    rows = docs.select("doc_id", "held_out", F.col("text").cast("string"))
    return stored(rows.mapInArrow(lambda batches: shard_rows(batches, shard_bytes), SHARDS), "lm-shards", 1)


def word_counts(shards: DataFrame, least: int = 1) -> DataFrame:
    """(word, c, shards): how often each word of the training texts occurs in shards that have it `least` times, and in how many."""
    pairs = shards.select(F.explode(F.arrays_zip("words", "n_train")).alias("w")).filter(F.col("w.n_train") >= least)
    return pairs.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.n_train").alias("c"), F.count(F.lit(1)).alias("shards"))


def frequent_words(shards: DataFrame, words: int, often: int = OFTEN) -> list[tuple[bytes, int]]:
    """The `words` most frequent words with their counts, of equals those first in order.

    Words are first counted where a shard has them `often` times, which leaves out most pairs of word and shard. A word
    may have up to often - 1 more in every other shard; those that could be among the first by that are counted fully. When
    too many could, as with few or tiny shards, all words are counted.
    """
    number = shards.count()
    seen = stored(word_counts(shards, often), "lm-often")
    most = F.col("c") + (often - 1) * (number - F.col("shards"))
    best = [r["c"] for r in seen.orderBy(F.desc("c")).limit(words).collect()]
    counts = None
    if len(best) == words and best[-1] > (often - 1) * number:
        near = stored(seen.filter(most >= best[-1]).select(F.col("word").alias("near")), "lm-near")
        if near.count() <= CANDIDATES * words:
            pairs = shards.select(F.explode(F.arrays_zip("words", "n_train")).alias("w")).select("w.words", "w.n_train")
            own = pairs.join(F.broadcast(near), F.col("words") == F.col("near"), "left_semi")
            counts = own.groupBy(F.col("words").alias("word")).agg(F.sum("n_train").alias("c"))
    if counts is None:
        counts = word_counts(shards)
    return [(bytes(r["word"]), r["c"]) for r in counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(words).collect()]


@dataclass(frozen=True)
class Model:
    """`words` by number; number len(words) is any other word, the next one stands before a text."""

    words: dict[bytes, int]
    total: int
    distinct: int
    # Training counts of the words by number; smoothed share of all other words, and log share of every target.
    counts: np.ndarray
    other: float
    unigram: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    PARAMETERS = ("rows", "near", "far", "targets", "bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.PARAMETERS]).astype(np.float64)

    def with_flat(self, values: np.ndarray) -> Model:
        parts, at = {}, 0
        for name in self.PARAMETERS:
            old = getattr(self, name)
            parts[name] = values[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return replace(self, **parts)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of words with these training counts."""
        return np.log10((counts + SMOOTHING) / (self.total + SMOOTHING * (self.distinct + 1)))

    def contexts(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.rows[last] @ self.near + self.rows[before] @ self.far


def new_model(shards: DataFrame, words: int = WORDS, dimensions: int = DIMENSIONS) -> Model:
    """Untrained parameters over the most frequent words; starts as the unigram model. The number of words is not known yet."""
    total = int(shards.agg(F.sum(F.aggregate("n_train", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0)
    top = frequent_words(shards, words)
    share = (np.array([c for _, c in top], np.float64) + SMOOTHING) / (total + SMOOTHING * (len(top) + 1))
    other = max(1.0 - share.sum(), 1e-12)
    rng, k = np.random.default_rng(3), len(top)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    unigram = np.log(np.append(share, other)).astype(np.float32)
    return Model(
        {word: i for i, (word, _) in enumerate(top)}, total, 0, np.array([c for _, c in top], np.int64),
        float(other), unigram, small(k + 2, dimensions), np.eye(dimensions, dtype=np.float32), 0.5 * np.eye(dimensions, dtype=np.float32), small(k + 1, dimensions), unigram.copy(),
    )


def numbered(names: np.ndarray, local: np.ndarray, lengths: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model numbers of every token of a shard and of the two tokens before it.

    `names` has the model number of each word of the shard, `other` that of other words.
    """
    target = names[local]
    first = np.cumsum(lengths) - lengths
    last, before = np.roll(target, 1), np.roll(target, 2)
    last[first] = before[first] = other + 1
    second = first[lengths > 1] + 1
    before[second] = other + 1
    return target, last, before


def row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the value rows that go to each of n rows."""
    # Numbers of two bytes are sorted digit by digit, several times faster.
    order = np.argsort(rows.astype(np.int16 if n <= 1 << 15 else np.int32), kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[rows[starts]] = np.add.reduceat(values.take(order, 0), starts, axis=0)
    return out


def shard_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """The columns of every shard as Arrow arrays; a list is the array of its values."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = ((f.name, batch.column(f.name)[i]) for f in batch.schema)
            yield {name: v.values if isinstance(v, pa.ListScalar) else v for name, v in values}


def names_of(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The number of each word among the `known` ones, their number for another word."""
    return pc.fill_null(pc.index_in(words, known.cast(words.type)), len(known)).to_numpy(zero_copy_only=False)


def places_of(shard: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the texts of a shard, and which of its tokens are for training."""
    lengths = shard["lengths"].to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, ~np.repeat(shard["held"].to_numpy(zero_copy_only=False).astype(bool), lengths)


class Trainer:
    """Noise-contrastive steps with per-parameter rates on the shards of one task.

    A step takes its tokens together by context and target, as few contexts are many times in a minibatch; the
    gradient is that of the single tokens.
    """

    def __init__(self, model: Model, noise: int = NOISE):
        self.model, self.noise = model, noise
        self.p = {name: getattr(model, name).copy() for name in Model.PARAMETERS}
        self.squares = {name: np.full_like(v, 0.01) for name, v in self.p.items()}
        self.share = np.exp(model.unigram.astype(np.float64))
        self.share /= self.share.sum()
        self.expected = np.log(noise * self.share).astype(np.float32)
        self.tokens = 0

    def shard(self, seed: int, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        """One pass over the tokens of a shard in random order."""
        self.tokens += len(target)
        rng, n = np.random.default_rng(seed & 0xFFFFFFFF), len(self.share)
        codes = before.astype(np.int64)
        codes *= n + 1
        codes += last
        codes *= n
        codes += target
        rng.shuffle(codes)
        for start in range(0, len(codes), MINIBATCH):
            self.step(codes[start : start + MINIBATCH], rng.choice(n, self.noise, p=self.share))

    def step(self, codes: np.ndarray, noise: np.ndarray) -> None:
        p, weight, n = self.p, np.float32(1 / MINIBATCH), len(self.expected)
        codes = np.sort(codes)
        firsts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        times = np.diff(firsts, append=len(codes)).astype(np.float32)
        pairs, t = np.divmod(codes[firsts], n)
        contexts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        b, a = np.divmod(pairs[contexts], n + 1)
        at = np.repeat(np.arange(len(contexts)), np.diff(contexts, append=len(pairs)))
        noise, repeats = np.unique(noise, return_counts=True)
        ra, rb, own, others = p["rows"].take(a, 0), p["rows"].take(b, 0), p["targets"].take(t, 0), p["targets"].take(noise, 0)
        offset = p["bias"] - self.expected
        vector = ra @ p["near"]
        vector += rb @ p["far"]
        # A logit beyond single precision's exp has a slope of zero, which dividing by infinity gives.
        each = vector.take(at, 0)
        with np.errstate(over="ignore"):
            up = -weight * times / (1 + np.exp(np.einsum("ij,ij->i", each, own) + offset[t]))
            down = vector @ others.T
            down += offset[noise]
            np.negative(down, out=down)
            np.exp(down, out=down)
        down += 1
        np.divide(weight * np.add.reduceat(times, contexts)[:, None] * repeats.astype(np.float32), down, out=down)
        right = up[:, None] * own
        back = down @ others
        back += np.add.reduceat(right, contexts, axis=0)
        each *= up[:, None]
        targets = row_sums(t, each, n)
        targets[noise] += down.T @ vector
        bias = np.bincount(t, up, n)
        bias[noise] += down.sum(axis=0)
        rows = row_sums(np.concatenate([a, b]), np.concatenate([back @ p["near"].T, back @ p["far"].T]), n + 1)
        grads = {"rows": rows, "near": ra.T @ back, "far": rb.T @ back, "targets": targets, "bias": bias.astype(np.float32)}
        for name, g in grads.items():
            squares = self.squares[name]
            squares += g * g
            p[name] -= LEARNING_RATE * g / np.sqrt(squares)

    def flat(self) -> np.ndarray:
        return replace(self.model, **self.p).flat()


def train(shards: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Parameters averaged over all tasks, weighted by their training tokens."""
    context = shards.sparkSession.sparkContext
    for turn in range(rounds if model.total else 0):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value)
            words = pa.array(list(trainer.model.words), pa.binary())
            for row in shard_columns(batches):
                lengths, training = places_of(row)
                target, last, before = numbered(names_of(row["words"], words), unpacked(row["tokens"].as_buffer()), lengths, len(words))
                if training.any():
                    trainer.shard(row["shard"].as_py() * 31 + turn, target[training], last[training], before[training])
            if trainer.tokens:
                values = trainer.flat() * trainer.tokens
                yield pa.RecordBatch.from_pydict(
                    {"i": np.arange(len(values)), "value": values, "weight": np.full(len(values), trainer.tokens, np.int64)}
                )

        used = shards.select("shard", "words", "tokens", "held", "lengths")
        sums = used.mapInArrow(run, "i long, value double, weight long").groupBy("i").agg(F.sum("value").alias("v"), F.sum("weight").alias("w"))
        found = sums.toArrow()
        values = np.zeros(found.num_rows)
        values[found.column("i").to_numpy()] = found.column("v").to_numpy() / found.column("w").to_numpy()
        model = model.with_flat(values)
    return model


def log_normalisers(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Natural log of the sum over all targets, per context vector."""
    out, ones = np.empty(len(vectors)), np.ones(len(model.bias), np.float32)
    longest = np.sqrt(np.square(model.targets).sum(axis=1).max())
    for start in range(0, len(vectors), CONTEXTS_AT_ONCE):
        own = vectors[start : start + CONTEXTS_AT_ONCE]
        logits = own @ model.targets.T
        logits += model.bias
        # Single precision holds sums of exp up to e**80; only larger ones need the maximum taken out.
        safe = np.sqrt(np.square(own).sum(axis=1).max()) * longest + np.abs(model.bias).max() < 60
        top = 0 if safe else logits.max(axis=1, keepdims=True)
        if not safe:
            logits -= top
        np.exp(logits, out=logits)
        out[start : start + CONTEXTS_AT_ONCE] = np.log(logits @ ones) + (0 if safe else top[:, 0])
    return out


def log_probabilities(model: Model, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 of the normalised first-level probability of every target number in its context."""
    return row_probabilities(model, target, *distinct_contexts(last, before, len(model.rows)), model.rows)


def distinct_contexts(last: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of context rows as two arrays, and which of them each place has."""
    codes = before.astype(np.int64)
    codes *= size
    codes += last
    if size * size <= PAIRS_IN_TABLE:
        seen = np.zeros(size * size, bool)
        seen[codes] = True
        pairs, number = np.flatnonzero(seen), np.empty(size * size, np.int32)
        number[pairs] = np.arange(len(pairs), dtype=np.int32)
        at = number[codes]
    else:
        pairs, at = np.unique(codes, return_inverse=True)
    return pairs % size, pairs // size, at


def row_probabilities(model: Model, target: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same for places that have context `at` of the pairs (a, b) in a table of context rows."""
    vectors, far, out = (rows @ model.near)[a], rows @ model.far, np.empty(len(target))
    for start in range(0, len(b), PLACES_AT_ONCE):
        own = slice(start, start + PLACES_AT_ONCE)
        vectors[own] += far[b[own]]
    normaliser = log_normalisers(model, vectors)
    for start in range(0, len(target), PLACES_AT_ONCE):
        own = slice(start, start + PLACES_AT_ONCE)
        t, pair = target[own], at[own]
        out[own] = np.einsum("ij,ij->i", vectors.take(pair, 0), model.targets.take(t, 0)) + model.bias[t] - normaliser[pair]
    out /= np.log(10)
    return out


def clusters(points: np.ndarray, weights: np.ndarray, k: int, turns: int = 30) -> np.ndarray:
    """Number of the nearest of k weighted means, per point; starts from points far apart."""
    rng, n = np.random.default_rng(5), len(points)
    best, least = np.zeros(n, np.int64), np.inf
    for _ in range(10):
        means = points[[rng.choice(n, p=weights / weights.sum())]]
        while len(means) < k:
            far = weights * np.square(points[:, None] - means).sum(axis=2).min(axis=1)
            means = np.vstack([means, points[rng.choice(n, p=far / far.sum()) if far.sum() > 0 else rng.integers(n)]])
        for _ in range(turns):
            distance = np.square(points[:, None] - means).sum(axis=2)
            own = distance.argmin(axis=1)
            for j in range(k):
                if (own == j).any():
                    means[j] = np.average(points[own == j], axis=0, weights=weights[own == j])
        loss = (weights * distance.min(axis=1)).sum()
        if loss < least:
            best, least = own, loss
    return best


def votes_of(model: Model, components: int = COMPONENTS) -> np.ndarray:
    """The component that every model number votes for; other words and the start have none (-1)."""
    k = len(model.words)
    votes = np.full(k + 2, -1)
    if k:
        points = np.hstack([model.rows[:k], model.targets[:k]]).astype(np.float64)
        points /= np.sqrt(np.square(points).sum(axis=1, keepdims=True)) + 1e-9
        votes[:k] = clusters(points, np.exp(model.unigram[:k].astype(np.float64)), components)
    return votes


def components_of(votes: np.ndarray, target: np.ndarray, lengths: np.ndarray, window: int = WINDOW, components: int = COMPONENTS) -> np.ndarray:
    """Component that most words around each place, itself left out, vote for, the first of equals; -1 without a vote."""
    n, gap = len(target), max(window, 0)
    # Places of the texts with a gap before and after each, in which nobody votes.
    at = np.arange(n) + gap * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    counts = np.empty((n, -(-components // 8) * 8), np.uint8)
    for block in range(0, components, 8):
        # Votes for eight components are the bytes of a number, so sums of numbers count them.
        one = np.zeros(len(votes), np.uint64)
        chosen = (votes >= block) & (votes < block + 8)
        one[chosen] = np.uint64(1) << (8 * (votes[chosen] - block)).astype(np.uint64)
        own, line = one[target], np.zeros(n + gap * (len(lengths) + 1) + 1, np.uint64)
        line[at + 1] = own
        # Sums run over without harm: their differences are right again.
        np.cumsum(line, out=line)
        counts[:, block : block + 8] = (line[at + gap + 1] - line[at - gap] - own).astype("<u8")[:, None].view(np.uint8)
    counts = counts[:, :components]
    found = counts.argmax(axis=1)
    return np.where(counts[np.arange(n), found] > 0, found, -1)


def text_blocks(lengths: np.ndarray, places: int) -> Iterator[tuple[slice, slice]]:
    """Neighbouring whole texts of up to so many places, a longer text alone: which texts, and which places they have."""
    ends, text, place = np.cumsum(lengths), 0, 0
    while text < len(lengths):
        last = max(text + 1, int(np.searchsorted(ends, place + places, "right")))
        yield slice(text, last), slice(place, int(ends[last - 1]))
        text, place = last, int(ends[last - 1])


def place_counts(names: np.ndarray, local: np.ndarray, lengths: np.ndarray, training: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target and context rows of the words of a shard: training places of each component, and such places after them."""
    n, k = len(names), COMPONENTS
    targets, contexts = np.zeros(n * k, np.int32), np.zeros(n * k, np.int32)
    for texts, places in text_blocks(lengths, VOTES_AT_ONCE):
        own = local[places]
        found = components_of(votes, names[own], lengths[texts])
        used = training[places] & (found >= 0)
        after = used[1:].copy()
        after[(np.cumsum(lengths[texts]) - 1)[:-1]] = False
        targets += np.bincount(own[used].astype(np.int64) * k + found[used], minlength=n * k)
        contexts += np.bincount(own[:-1][after].astype(np.int64) * k + found[1:][after], minlength=n * k)
    return targets.reshape(n, k), contexts.reshape(n, k)


def word_rows(shards: DataFrame, model: Model, components: int = COMPONENTS) -> DataFrame:
    """(word, c, t, n): count, target row and context row of each training word, summed over the corpus."""
    shared = shards.sparkSession.sparkContext.broadcast((list(model.words), votes_of(model, components)))
    columns = [*(f"t{k}" for k in range(components)), *(f"n{k}" for k in range(components))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, votes = pa.array(shared.value[0], pa.binary()), shared.value[1]
        for row in shard_columns(batches):
            spelled, (lengths, training) = row["words"], places_of(row)
            t, n = place_counts(names_of(spelled, words), unpacked(row["tokens"].as_buffer()), lengths, training, votes)
            counts = row["n_train"].to_numpy(zero_copy_only=False)
            seen = np.flatnonzero(counts > 0)
            # Bounded batches: a shard may have very many words.
            for at in np.array_split(seen, len(seen) // 65536 + 1):
                values = [spelled.take(pa.array(at)), pa.array(counts[at])]
                values += [pa.array(np.ascontiguousarray(v[at, k])) for v in (t, n) for k in range(components)]
                yield pa.RecordBatch.from_arrays(values, names=["word", "c", *columns])

    used = shards.select("words", "n_train", "tokens", "held", "lengths")
    parts = used.mapInArrow(run, ", ".join(["word binary", "c int", *(f"{c} int" for c in columns)]))
    sums = parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ["c", *columns]))
    return stored(sums.select("word", "c", F.array(*columns[:components]).alias("t"), F.array(*columns[components:]).alias("n")), "lm-rows")


def shares_of(places: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Share of each component given rows of places; the shares of all without any."""
    return (places + PRIOR * shares) / (places.sum(axis=1, keepdims=True) + PRIOR)


def codes_of(places: np.ndarray, shares: np.ndarray, levels: tuple[float, ...]) -> np.ndarray:
    """Code of rows of places: the two largest components and the steps of their shares; 0 without places."""
    own, steps, row = shares_of(places, shares), len(levels) + 1, np.arange(len(places))
    first = own.argmax(axis=1)
    rest = own.copy()
    rest[row, first] = -1
    second = rest.argmax(axis=1)
    codes = first * steps + np.searchsorted(levels, own[row, first])
    codes = (codes * own.shape[1] + second) * steps + np.searchsorted(levels, own[row, second])
    return np.where(places.sum(axis=1) > 0, codes + 1, 0)


def code_count(components: int, levels: tuple[float, ...]) -> int:
    return (components * (len(levels) + 1)) ** 2 + 1


@dataclass(frozen=True)
class Sharing:
    """How "another word" is shared out: by components, with what the codes of words mean.

    Context rows are the frequent words by number, then the start of a text, then the context codes:
    `rows` has their R, `pulls` the log of what they make of the shares of the components.
    """

    shares: np.ndarray
    normalisers: np.ndarray
    target_book: np.ndarray
    rows: np.ndarray
    pulls: np.ndarray

    def log_shares(self, counts: np.ndarray, codes: np.ndarray, word: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 p(word | another word, context) for places in the tables of words and contexts given."""
        pull = np.empty((len(a), len(self.shares)))
        for start in range(0, len(a), PLACES_AT_ONCE):
            own = slice(start, start + PLACES_AT_ONCE)
            part = np.log(self.shares) + NEAR * self.pulls[a[own]] + FAR * self.pulls[b[own]]
            part = np.exp(part - part.max(axis=1, keepdims=True))
            pull[own] = part / part.sum(axis=1, keepdims=True)
        per_word = (counts + SMOOTHING)[:, None] * (self.target_book / self.normalisers)[codes]
        out = np.empty(len(word))
        for start in range(0, len(word), PLACES_AT_ONCE):
            own = slice(start, start + PLACES_AT_ONCE)
            out[own] = np.log10(np.einsum("ij,ij->i", pull.take(at[own], 0), per_word.take(word[own], 0)))
        return out


def lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def code_sums(others: DataFrame, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per target code and per context code: summed shares of the words by count, then counts, then words."""
    k = len(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((code_count(k, levels), k + 2)) for levels in (TARGET_LEVELS, CONTEXT_LEVELS)]
        for batch in batches:
            counts = batch.column(0).to_numpy(zero_copy_only=False)
            for total, column, levels in zip(sums, (1, 2), (TARGET_LEVELS, CONTEXT_LEVELS)):
                places = lists(batch.column(column), k)
                codes = codes_of(places, shares, levels)
                values = np.hstack([shares_of(places, shares) * counts[:, None], counts[:, None], np.ones((len(counts), 1))])
                for j in range(k + 2):
                    total[:, j] += np.bincount(codes, values[:, j], len(total))
        for kind, total in enumerate(sums):
            seen = np.flatnonzero(total[:, k + 1])
            yield pa.RecordBatch.from_pydict({"kind": np.full(len(seen), kind), "code": seen, **{f"s{j}": total[seen, j] for j in range(k + 2)}})

    names = [f"s{j}" for j in range(k + 2)]
    parts = others.select("c", "t", "n").mapInArrow(run, "kind long, code long, " + ", ".join(f"{c} double" for c in names))
    out = [np.zeros((code_count(k, levels), k + 2)) for levels in (TARGET_LEVELS, CONTEXT_LEVELS)]
    # At most as many rows as there are codes.
    for row in parts.groupBy("kind", "code").agg(*(F.sum(c).alias(c) for c in names)).collect():
        out[row["kind"]][row["code"]] = [row[c] for c in names]
    return out[0], out[1]


def sharing(rows: DataFrame, model: Model, components: int = COMPONENTS) -> Sharing:
    """Two passes over the rows of the other words: places of each component, then what the codes mean."""
    numbers = rows.sparkSession.createDataFrame(list(model.words.items()), "word binary, number int")
    others = rows.join(F.broadcast(numbers), "word", "left_anti")
    found = others.agg(*(F.sum(F.col("t")[k]) for k in range(components))).first()
    places = np.array([v or 0 for v in found], np.float64) + 1
    shares = places / places.sum()
    targets, contexts = code_sums(others, shares)

    def book(sums: np.ndarray) -> np.ndarray:
        mass = sums[:, components : components + 1]
        return np.where(mass > 0, sums[:, :components] / np.maximum(mass, 1e-300), shares)

    target_book, context_book = book(targets), book(contexts)
    weight = targets[:, components] + SMOOTHING * targets[:, components + 1]
    normalisers = weight @ target_book + SMOOTHING * shares
    # R by component: mean of the frequent words that vote for it, less the mean over components.
    k = len(model.words)
    votes = np.eye(components)[votes_of(model, components)[:k]] * np.exp(model.unigram[:k].astype(np.float64))[:, None]
    means = votes.T @ model.rows[:k] / np.maximum(votes.sum(axis=0), 1e-12)[:, None]
    known = np.zeros((k, components))
    for row in rows.join(F.broadcast(numbers), "word").select("number", "n").collect():
        known[row["number"]] = row["n"]
    moved = model.rows[k] + context_book @ (means - shares @ means)
    pulls = [np.log(shares_of(known, shares) / shares), np.zeros((1, components)), np.log(context_book / shares)]
    return Sharing(shares, normalisers, target_book, np.vstack([model.rows[:k], model.rows[k + 1 :], moved]).astype(np.float32), np.vstack(pulls))


def packed_words(others: DataFrame, shares: np.ndarray) -> DataFrame:
    """(word, packed): count, target code and context code of each word in one number."""
    k = len(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            t, n = (codes_of(lists(batch.column(i), k), shares, levels) for i, levels in ((2, TARGET_LEVELS), (3, CONTEXT_LEVELS)))
            packed_ = (counts << TARGET_BITS | t) << CONTEXT_BITS | n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed_.astype(np.int64))], names=["word", "packed"])

    return others.select("word", "c", "t", "n").mapInArrow(run, "word binary, packed long")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def shard_scores(row: dict, names: np.ndarray, packed_: np.ndarray, model: Model, share: Sharing) -> pa.Table:
    """Scores of all texts of a shard, given the model number and the packed row of each of its words."""
    lengths, local, k = np.array(row["lengths"], np.int64), unpacked(row["tokens"]), len(model.words)
    counts = np.where(names < k, np.append(model.counts, 0)[names], packed_ >> TARGET_BITS + CONTEXT_BITS)
    codes = (packed_ >> CONTEXT_BITS) & ((1 << TARGET_BITS) - 1)
    context = np.where(names < k, names, k + 1 + (packed_ & ((1 << CONTEXT_BITS) - 1))).astype(np.int32)
    a, b, at = distinct_contexts(*numbered(context, local, lengths, k - 1)[1:], len(share.rows))
    first = np.cumsum(lengths) - lengths
    base, target = model.base(counts), names[local]
    neural = row_probabilities(model, target, a, b, at, share.rows)
    other = np.flatnonzero(target == k)
    neural[other] += share.log_shares(counts, codes, local[other], a, b, at[other])
    columns = [
        pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths),
        pa.array(np.add.reduceat((counts > 0)[local].astype(np.int64), first)),
        pa.array(np.add.reduceat(base[local], first)), pa.array(np.add.reduceat(neural, first)),
    ]
    return pa.Table.from_arrays(columns, schema=SCORES_ARROW)


def score_texts(docs: DataFrame, shard_bytes: int = SHARD_BYTES, words: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row of `docs`.

    `docs` has doc_id, text and held_out; counts and model come from rows not held out.
    """
    shards = build_shards(docs, shard_bytes)
    model = train(shards, new_model(shards, words), rounds)
    rows = word_rows(shards, model)
    model = replace(model, distinct=rows.count())
    share = sharing(rows, model)
    shared = docs.sparkSession.sparkContext.broadcast((model, share))
    numbers = F.broadcast(docs.sparkSession.createDataFrame(list(model.words.items()), "word binary, number long"))
    own = shards.select(F.col("shard").alias("part"), F.posexplode("words").alias("at", "word"))
    # Frequent words are in every shard; they never meet in a join. Below zero stands the model number.
    frequent = own.join(numbers, "word").select("part", "at", (-1 - F.col("number")).alias("packed"))
    others = packed_words(rows.join(numbers, "word", "left_anti"), share.shares)
    known = own.join(numbers, "word", "left_anti").join(others, "word").select("part", "at", "packed").unionByName(frequent)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row, (model, share) = left.to_pylist()[0], shared.value
        packed_, names = np.zeros(row["n_words"], np.int64), np.full(row["n_words"], len(model.words), np.int64)
        at, found = right.column("at").to_numpy(), right.column("packed").to_numpy()
        packed_[at] = np.maximum(found, 0)
        names[at[found < 0]] = -1 - found[found < 0]
        return shard_scores(row, names, packed_, model, share)

    texts = shards.select("shard", F.size("words").alias("n_words"), "tokens", "doc_ids", "held", "lengths")
    scored = texts.groupBy("shard").cogroup(known.groupBy("part")).applyInArrow(score, SCORES)
    names = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"]
    return scored.select(*names)
