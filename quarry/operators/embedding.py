"""Text to vectors: the model interface and its distributed application."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_TEXTS = 32
# Texts whose vectors are held at a time; Arrow batches of texts can be larger.
HELD_TEXTS = 512

_VECTORS = "struct<embedding: array<float>, sparse: map<string, float>>"
_DENSE = "struct<embedding: array<float>>"
_WORD = re.compile(r"[^\W\d_]+")


class Embedder(Protocol):
    """A model that runs inside the tasks. Instances are pickled, so load lazily."""

    def load(self) -> None:
        """Prepare the model; called once per task."""

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[dict[str, float]]]:
        """One unit vector and one token-weight map per text."""


class HashedWords:
    """Deterministic default without a model: hashed word counts.

    Dense: words are hashed into `dims` buckets, counts scaled to unit length.
    Sparse: word to its count.
    """

    def __init__(self, dims: int = 1024):
        self.dims = dims

    def load(self) -> None:
        pass

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[dict[str, float]]]:
        counts = [Counter(_WORD.findall(t.lower())) for t in texts]
        at = [i * self.dims + word_bucket(w, self.dims) for i, c in enumerate(counts) for w in c]
        times = [n for c in counts for n in c.values()]
        dense = np.bincount(np.array(at, np.int64), np.array(times, np.float64), len(texts) * self.dims).reshape(len(texts), self.dims)
        norms = np.linalg.norm(dense, axis=1, keepdims=True)
        return dense / np.where(norms > 0, norms, 1.0), counts


@lru_cache(maxsize=200_000)
def word_bucket(word: str, dims: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dims


def _encode(embedder: Embedder, texts: list[str]) -> pa.StructArray:
    dense, sparse = embedder.encode(texts)
    if len(dense) != len(texts) or len(sparse) != len(texts):
        raise ValueError(f"{len(texts)} texts but {len(dense)} dense and {len(sparse)} sparse vectors")
    return _vector_array(dense, sparse)


def _vector_array(dense: np.ndarray, sparse: list[dict[str, float]]) -> pa.StructArray:
    """Both vectors as one Arrow struct column, built from flat arrays."""
    matrix = np.asarray(dense, dtype=np.float32).reshape(len(sparse), -1 if len(sparse) else 0)
    vectors = pa.ListArray.from_arrays(
        pa.array(np.arange(len(sparse) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel(), pa.float32())
    )
    ends = np.cumsum([0, *map(len, sparse)])
    tokens = pa.array([w for words in sparse for w in words], pa.string())
    weights = pa.array([x for words in sparse for x in words.values()], pa.float64()).cast(pa.float32())
    maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), tokens, weights)
    return pa.StructArray.from_arrays([vectors, maps], ["embedding", "sparse"])


def embed(
    df: DataFrame, embedder: Embedder, text: str = "text", batch: int = BATCH_TEXTS, strict: bool = True, sparse: bool = True
) -> DataFrame:
    """Add `embedding` and `sparse` columns; without `sparse` only the first.

    A narrow map: the model is loaded once per task, texts go to it in batches, and a task holds the vectors of
    about `HELD_TEXTS` texts.
    A model that fails, or returns another number of vectors than texts, is an error;
    unless `strict`, the texts of that batch get no vectors instead.
    """

    def encoded(texts: list[str]) -> pa.StructArray:
        try:
            return _encode(embedder, texts)
        except Exception:
            if strict:
                raise
            return pa.nulls(len(texts), _vector_array([], []).type)

    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder.load()
        for column in batches:
            for texts in held_texts(column, max(1, HELD_TEXTS // batch) * batch):
                parts = [encoded([t or "" for t in texts[at : at + batch]]) for at in range(0, len(texts), batch)]
                found = pa.concat_arrays(parts) if parts else _vector_array([], [])
                yield found if sparse else _only_dense(found)

    kinds = ["embedding", "sparse"] if sparse else ["embedding"]
    found = F.arrow_udf(_VECTORS if sparse else _DENSE)(vectors)(F.col(text))
    return df.withColumn("__v", found).select("*", *(f"__v.{k}" for k in kinds)).drop("__v")


def _only_dense(vectors: pa.StructArray) -> pa.StructArray:
    # `flatten` keeps what was null as a whole null.
    return pa.StructArray.from_arrays([vectors.flatten()[0]], ["embedding"])


def held_texts(column: pa.Array, size: int) -> Iterator[list[str | None]]:
    """The texts of a column, `size` of them at a time; an empty list of an empty one."""
    for at in range(0, max(1, len(column)), size):
        yield column.slice(at, size).to_pylist()


def sparse_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse vectors as `(keys, token, weight)` rows.

    The outer form of explode: the plain one adds a filter on the vectors, which
    would run the model a second time below it.
    """
    long = df.select(*keys, F.explode_outer("sparse").alias("token", "weight"))
    return long.filter(F.col("token").isNotNull())
