"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased byte-wise, everything but letters becomes one blank, and all
2-, 3- and 4-byte subwords are hashed to rows of an embedding table. The mean row
goes through a linear softmax. The model is trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows (`TRAIN_DOCS` in all, shared evenly by
the languages); a fifth of the sample sets the temperature and the score below
which a prediction is rejected.

Since the softmax is linear, an embedding row times the weights gives its share of
every logit, so scoring adds up rows of one small table over the whole text.

Defined results: null texts and texts without a letter are `und` with score 0 and
rejected. Without any labelled row everything is `und`. Equal texts get equal
results; a language name is any non-null value of `lang`. Very long texts are hashed whole. An empty table has
no rows. Extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import free_name

UNDETERMINED = "und"
BITS = 14
SUBWORDS = (2, 3, 4)
DIMENSIONS = 16
TRAIN_DOCS = 2000
EPOCHS = 12
LEARNING_RATE = 0.5
# Share of rightly predicted calibration texts that rejection may cost.
REJECTED_SHARE = 0.004
# Subwords looked up at once, so that a long text needs no more memory.
BLOCK = 1 << 18

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def has_letter(raw: bytes | None) -> bool:
    return raw is not None and next(filter(str.isalpha, raw.decode("utf-8", "replace")), None) is not None


def subword_blocks(raw: bytes):
    """Hashed subwords of a whole text, in blocks of bounded size."""
    letters = _LETTERS[np.frombuffer(b" " + raw + b" ", np.uint8)]
    blank = letters == 0x20
    keep = np.ones(len(letters), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    letters = letters[keep]
    for start in range(0, len(letters), BLOCK):
        part = letters[start : start + BLOCK + max(SUBWORDS) - 1].astype(np.uint32)
        own = min(BLOCK, len(letters) - start)
        rolled = part
        for n in range(2, max(SUBWORDS) + 1):
            rolled = rolled[:-1] * np.uint32(16777619) + part[n - 1 :]
            if n in SUBWORDS:
                yield ((rolled[:own] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def subword_counts(raw: bytes) -> np.ndarray:
    counts = np.zeros(1 << BITS, np.int64)
    for block in subword_blocks(raw):
        counts += np.bincount(block, minlength=1 << BITS)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    """`table` has a row of logit shares per subword; logits are divided by `temperature`."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, raw: bytes | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not self.languages or not has_letter(raw):
            return UNDETERMINED, 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for block in subword_blocks(raw):
            total += self.table[block].sum(axis=0, dtype=np.float64)
            n += len(block)
        p = softmax((total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        score = float(min(p[best], 1.0))
        return self.languages[best], score, score < self.threshold


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fit on at most `train_docs` rows (`doc_id`, `text`, `lang`) of the given frame.

    Every language gets the same share, its rows chosen by a hash of the id and text. The
    rows' subword counts go to the driver: at most 98 kB each.
    """
    labelled = docs.filter(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id"
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel((), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 1.0)
    share = max(1, train_docs // len(sizes))
    rate = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 1.5 * share / v + 20 / v))])
    order = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20))
    drawn = labelled.withColumn("order", order).filter(F.col("order") < rate[F.col("lang")] * (1 << 20))
    first = Window.partitionBy("lang").orderBy("order", "doc_id", F.xxhash64("text"))
    sample = drawn.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= share)

    @F.arrow_udf("struct<at: binary, share: binary>")
    def features(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in texts.cast(pa.binary()).to_pylist():
            counts = subword_counts(raw) if has_letter(raw) else np.zeros(1, np.int64)
            at = np.flatnonzero(counts)
            rows.append({"at": at.astype(np.uint16).tobytes(), "share": (counts[at] / max(1, counts.sum())).astype(np.float32).tobytes()})
        return pa.array(rows, pa.struct([("at", pa.binary()), ("share", pa.binary())]))

    rows = sample.select("lang", "rank", features("text").alias("x")).collect()
    rows = sorted((r for r in rows if r["x"]["at"]), key=lambda r: (r["rank"], r["lang"]))
    languages = tuple(sorted(sizes))
    x = [(np.frombuffer(r["x"]["at"], np.uint16), np.frombuffer(r["x"]["share"], np.float32)) for r in rows]
    y = np.array([languages.index(r["lang"]) for r in rows], np.int64)
    return fit(x, y, languages)


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: tuple[str, ...]) -> LanguageModel:
    """Stochastic gradient descent, then temperature and threshold on every fifth row."""
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 5 * len(languages) else np.zeros(len(y), bool)
    rows = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = LEARNING_RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(rows):
            at, share = x[i]
            hidden = share @ embed[at]
            slope = softmax(hidden @ weights + bias)
            slope[y[i]] -= 1
            back = weights @ slope
            weights -= rate * np.outer(hidden, slope)
            bias -= rate * 0.1 * slope
            # Shares are small numbers; without the factor rare subwords would hardly move.
            embed[at] -= rate * len(at) * 0.05 * np.outer(share, back)
    table = embed @ weights
    check = np.flatnonzero(held) if held.any() else rows
    logits = np.array([x[i][1] @ table[x[i][0]] + bias for i in check]).reshape(len(check), len(languages))

    def loss(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(check)), y[check]]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss) if len(check) else 1.0
    p = softmax(logits / temperature)
    right = p.argmax(axis=1) == y[check]
    scores = p.max(axis=1)[right]
    # Of n + 1 texts of the learned languages at most this share scores less; too few rows to tell reject nothing.
    rank = int(REJECTED_SHARE * (len(scores) + 1))
    threshold = float(np.sort(scores)[rank - 1]) if rank else 0.0
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, threshold)


RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predict_column(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred, score and rejected."""

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        rows = map(model.predict, texts.cast(pa.binary()).to_pylist())
        return pa.array([dict(zip(("lang_pred", "score", "rejected"), r)) for r in rows], RESULT)

    return predict(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns and rows of `docs`, with lang_pred, score and rejected (replacing columns so named)."""
    name = free_name(docs, "prediction")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*kept, predict_column(F.col("text"), model).alias(name)).select(*kept, f"{name}.*")


def filter_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of `docs` whose prediction is not rejected; columns unchanged."""
    name = free_name(docs, "prediction")
    judged = docs.withColumn(name, predict_column(F.col("text"), model))
    return judged.filter(~F.col(f"{name}.rejected")).drop(name)
