"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut into pieces by the tokenizer's pattern; a piece that is a token
stands for itself, any other is merged. Leaf i of the piece's segment tree holds the rank of the
pair that starts at byte i (or `NONE`), every inner node the least value below it. Values are
rank * leaves + position, so the root names the leftmost pair of least rank. A merge
takes out the right token's leaf and updates the leaves of the two pairs around
the new token: three point updates of logarithmic cost.

Pieces of up to `BATCH_PIECE` bytes are merged many at a time, one tree per row of a numpy
array; longer ones have a tree of their own. Each worker keeps a bounded cache of
pieces. Vocabulary files are read by the driver and sent to the executors (they
have a fixed size); their path is a parameter.

Defined results: a null text is encoded like an empty one, to no ids. Any
string round-trips. Repeated rows are encoded each. Very long texts are encoded whole. An empty table has
no rows. Extra columns are kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name

BATCH_PIECE = 64
# Bytes of cached pieces, each counted with what a cache entry takes besides.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 160
# Pieces encoded and hashed at once, so that a long text needs no more memory.
PIECES_AT_ONCE = 100_000
NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Tokens by rank and a sorted table of the pairs that merge."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = rank
        self.pairs = np.array(sorted(merges), np.int64)
        self.pair_ranks = np.array([merges[p] for p in self.pairs.tolist()] + [NONE], np.int64)
        self.merges = merges
        first, second = np.meshgrid(self.bytes, self.bytes, indexing="ij")
        self.byte_pair_ranks = self.rank(first.ravel(), second.ravel()).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `NONE` where there is none or a side is missing (-1)."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        known = (right >= 0) & (left >= 0) & (at < len(self.pairs))
        known[known] = self.pairs[at[known]] == key[known]
        return np.where(known, self.pair_ranks[np.where(known, at, -1)], NONE)


def encode_long(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Merge one piece with a segment tree of its own."""
    n = len(piece)
    leaves = 1 << max(1, (n - 1).bit_length())
    tokens = [int(vocabulary.bytes[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges, none = vocabulary.merges, int(NONE)

    def value(i: int) -> int:
        if i < 0 or after[i] >= n:
            return none
        rank = merges.get(tokens[i] << 32 | tokens[after[i]])
        return none if rank is None else rank * leaves + i

    tree = [none] * (2 * leaves)
    tree[leaves : leaves + n] = [value(i) for i in range(n)]
    for k in range(leaves - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, new: int) -> None:
        k = leaves + i
        tree[k] = new
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    while tree[1] != none:
        rank, i = divmod(tree[1], leaves)
        right = after[i]
        tokens[i], after[i] = rank, after[right]
        if after[i] < n:
            before[after[i]] = i
        put(right, none)
        put(i, value(i))
        if before[i] >= 0:
            put(before[i], value(before[i]))
    out, i = [], 0
    while i < n:
        out.append(tokens[i])
        i = after[i]
    return out


def encode_batch(pieces: list[bytes], vocabulary: Vocabulary, leaves: int) -> list[bytes]:
    """Merge pieces of at most `leaves` bytes together, a segment tree per row.

    Returns each piece's ids as little-endian 32-bit integers.
    """
    m, sizes = len(pieces), np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join([p.ljust(leaves, b"\0") for p in pieces]), np.uint8).reshape(m, leaves)
    place = np.arange(leaves, dtype=np.int32)
    inside = place < sizes[:, None]
    # A column behind the last byte stands for "no neighbour"; so does -1, its other name.
    tokens = np.full((m, leaves + 1), -1, np.int64)
    tokens[:, :leaves] = np.where(inside, vocabulary.bytes[raw], -1)
    after = np.where(place + 1 < sizes[:, None], place + 1, leaves)
    before = np.empty((m, leaves + 1), np.int32)
    before[:] = np.arange(-1, leaves)
    tree = np.full((m, 2 * leaves), NONE, np.int32)
    ranks = vocabulary.byte_pair_ranks[(raw[:, :-1].astype(np.int32) << 8) + raw[:, 1:]]
    tree[:, leaves:-1] = np.where((ranks == NONE) | ~inside[:, 1:], NONE, ranks * leaves + place[:-1])
    for k in range(leaves - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    def put(rows: np.ndarray, at: np.ndarray, new: np.ndarray | int) -> None:
        node = leaves + at
        tree[rows, node] = new
        for _ in range(leaves.bit_length() - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = vocabulary.rank(tokens[rows, at], tokens[rows, after[rows, at]])
        return np.where(rank == NONE, NONE, rank * leaves + at)

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        rank, i = np.divmod(tree[rows, 1], leaves)
        right = after[rows, i]
        beyond = after[rows, right]
        tokens[rows, i], after[rows, i] = rank, beyond
        before[rows, beyond] = i
        tokens[rows, right] = -1
        put(rows, right, NONE)
        put(rows, i, pair(rows, i))
        left = before[rows, i]
        has_left = left >= 0
        put(rows[has_left], left[has_left], pair(rows[has_left], left[has_left]))
        rows = rows[tree[rows, 1] != NONE]
    flat = tokens[:, :leaves]
    alive = flat >= 0
    ids, ends = flat[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
    return [ids[start:end] for start, end in zip([0, *ends], ends)]


class Encoder:
    """Ids of texts, with a bounded cache of pieces."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary, self.pattern = Vocabulary(rank_file), regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def room(self, pieces: set[str]) -> bool:
        return self.cached + sum(map(len, pieces)) + ENTRY_BYTES * len(pieces) <= CACHE_BYTES

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces, as little-endian 32-bit integers, into the cache."""
        if not self.room(pieces):
            self.cache.clear()
            self.cached = 0
        self.cached += sum(map(len, pieces)) + ENTRY_BYTES * len(pieces)
        rows: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.vocabulary.ranks.get(raw)
            if rank is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(raw) > BATCH_PIECE:
                self.cache[piece] = np.array(encode_long(raw, self.vocabulary), "<u4").tobytes()
            else:
                rows.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for leaves, found in rows.items():
            ids = encode_batch([raw for _, raw in found], self.vocabulary, leaves)
            self.cache.update(zip([piece for piece, _ in found], ids))

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """Ids of a whole text, in portions."""
        if not text:
            return
        matches = self.pattern.finditer(text)
        while pieces := [m.group() for m in islice(matches, PIECES_AT_ONCE)]:
            self.learn_new(set(pieces))
            yield self.cached_ids(pieces)

    def learn_new(self, pieces: set[str]) -> None:
        """Afterwards all these pieces are in the cache."""
        missing = {p for p in pieces if p not in self.cache}
        if missing:
            held = {} if self.room(missing) else {p: self.cache[p] for p in pieces - missing}
            self.learn(missing)
            self.cache.update(held)

    def cached_ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, pieces)), "<u4")

    def encode_all(self, texts: list[str | None]) -> Iterator[Iterator[np.ndarray]]:
        """The ids of each text; new pieces of many short texts are learned together."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= PIECES_AT_ONCE):
                size += len(texts[stop] or "")
                stop += 1
            if size > PIECES_AT_ONCE:
                yield self.encode(texts[start])
            else:
                cut = [self.pattern.findall(text) if text else [] for text in texts[start:stop]]
                self.learn_new({p for pieces in cut for p in pieces})
                for pieces in cut:
                    yield iter([self.cached_ids(pieces)])
            start = stop

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(rank_file, pattern)


ENCODED = pa.struct([("ids", pa.list_(pa.int32()))])
DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _rank_file(spark, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_column(spark, text: Column, path: str, pattern: str) -> Column:
    """The ids of a text as array<int>."""
    ranks = _rank_file(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = encoder(ranks.value, pattern)
        rows = [np.concatenate([*portions, np.zeros(0, "<u4")]).astype(np.int32) for portions in own.encode_all(texts.to_pylist())]
        return pa.array(rows, pa.list_(pa.int32()))

    return encode(text.cast("string"))


def decode_column(spark, ids: Column, path: str) -> Column:
    """The bytes that an array<int> of ids stands for; null for null."""
    ranks = _rank_file(spark, path)

    @F.arrow_udf("binary")
    def decode(rows: pa.Array) -> pa.Array:
        own = encoder(ranks.value, "")
        return pa.array([None if r is None else own.decode(np.array(r, np.int64)) for r in rows.to_pylist()], pa.binary())

    return decode(ids)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row, portion by portion without holding the ids."""
    ranks, name = _rank_file(docs.sparkSession, path), free_name(docs, "encoded")

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digests(texts: pa.Array) -> pa.Array:
        own, rows = encoder(ranks.value, pattern), []
        for portions in own.encode_all(texts.to_pylist()):
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in portions:
                n += len(ids)
                ids_hash.update(ids.tobytes())
                text_hash.update(own.decode(ids))
            rows.append({"n_tokens": n, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": text_hash.hexdigest()})
        return pa.array(rows, DIGESTS)

    encoded = docs.select("doc_id", digests(F.col("text").cast("string")).alias(name))
    return encoded.select("doc_id", f"{name}.*")
