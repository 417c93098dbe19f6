"""Benchmark decontamination with a distributed positional inverted index.

`build_index` writes the index of the training texts once: a row is a shard of about
`SHARD_BYTES` of text with its terms, and for every term the word positions at which
it stands (all tokens, whole texts). Documents are laid end to end in a shard with a
free position between them, so no phrase can run over the end of a document.

`search` takes phrases (windows of test words). Inside a shard every window starts
from its rarest term there: the term's positions minus its offset are the possible
starts, and the lists of the next rarest terms, adjusted by their offsets, are
intersected with them until none is left. What remains are exact phrase matches;
with `slop` above 0 each word may also stand up to that many positions away from its place
inside the same document (proximity matches). Nothing but shards is ever grouped, so
frequent terms and passages do not gather anywhere. Test phrases come in
blocks of bounded size; every block is searched in all shards.

Defined results: null, empty and word-less texts have no words and no hits; items
without a word match nothing. Repeated items with one id count once; equal
windows of several items hit for each of them; a null item id is left out of the
list but its windows hit. Repeated rows are judged each. Very long texts are indexed whole. An empty
table has no rows, and without items nothing is hit. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored, text_key, without, words_in

WINDOW_WORDS = 10
SHARD_BYTES = 8 << 20
# Bytes of test phrases searched in one pass over the index.
BLOCK_BYTES = 16 << 20

# Bytes of words in lower case, all others blanks: digits, letters and everything beyond ASCII.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(raw: bytes | None) -> Iterable[bytes]:
    return words_in((raw or b"").translate(_WORD_BYTES))


INDEX = (
    "shard string, doc_ids array<bigint>, text_hashes array<bigint>, n_words array<bigint>, terms array<binary>, "
    "counts binary, gaps binary"
)
INDEX_ARROW = pa.schema(
    [
        ("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("text_hashes", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
        ("terms", pa.list_(pa.binary())), ("counts", pa.binary()), ("gaps", pa.binary()),
    ]
)


class ShardWriter:
    """Collects documents and turns them into one row of the index."""

    def __init__(self, name: str):
        self.name, self.size = name, 0
        self.doc_ids, self.hashes, self.n_words, self.ids = [], [], [], []
        self.terms: defaultdict[bytes, int] = defaultdict(lambda: len(self.terms))

    def add(self, doc_id: int | None, text_hash: int, raw: bytes | None) -> None:
        ids = np.fromiter(map(self.terms.__getitem__, words_of(raw)), np.int32)
        self.ids.append(ids)
        self.doc_ids.append(doc_id)
        self.hashes.append(text_hash)
        self.n_words.append(len(ids))
        self.size += len(raw or b"")

    def row(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        # One free position after each document.
        positions = np.arange(len(ids)) + np.repeat(np.arange(len(self.n_words)), self.n_words)
        order = np.argsort(ids, kind="stable")
        counts, positions = np.bincount(ids, minlength=len(self.terms)), positions[order]
        gaps = np.diff(positions, prepend=0)
        first = np.cumsum(counts) - counts
        gaps[first] = positions[first]
        values = [
            [self.name], [self.doc_ids], [self.hashes], [self.n_words], [list(self.terms)],
            [counts.astype(np.int32).tobytes()], [gaps.astype(np.int32).tobytes()],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, INDEX_ARROW)], schema=INDEX_ARROW)


def index_rows(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    writer = ShardWriter(f"{task}-{number}")
    for batch in batches:
        columns = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
        for doc_id, text_hash, raw in zip(*columns):
            if writer.doc_ids and writer.size + len(raw or b"") > shard_bytes:
                yield writer.row()
                number += 1
                writer = ShardWriter(f"{task}-{number}")
            writer.add(doc_id, text_hash, raw)
    if writer.doc_ids:
        yield writer.row()


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the positional index of all texts and return the written table."""
    rows = docs.select(*text_key(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(lambda batches: index_rows(batches, shard_bytes), INDEX), "positional-index")


class Phrases:
    """Distinct windows of test words with the items they come from."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window_words: int):
        owners: defaultdict[tuple[bytes, ...], set] = defaultdict(set)
        for item_id, raw in items:
            words = list(words_of(raw))
            for start in range(max(1, len(words) - window_words + 1) if words else 0):
                owners[tuple(words[start : start + window_words])].add(item_id)
        names = {word: k for k, word in enumerate(dict.fromkeys(w for window in owners for w in window))}
        self.terms = pa.array(list(names), pa.binary())
        self.windows = [np.array([names[w] for w in window], np.int64) for window in owners]
        self.flat = np.concatenate([*self.windows, np.zeros(0, np.int64)])
        self.firsts = np.cumsum([0, *map(len, self.windows)])[:-1]
        self.owners = [sorted(ids - {None}) for ids in owners.values()]

    def among(self, present: np.ndarray) -> list[int]:
        """Windows all of whose terms are present."""
        return np.flatnonzero(np.logical_and.reduceat(present[self.flat], self.firsts)).tolist() if self.windows else []


class ShardReader:
    """Posting lists of the test terms inside one shard."""

    def __init__(self, row: dict, phrases: Phrases):
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.ends = np.cumsum(counts)
        self.counts, self.gaps = counts, np.frombuffer(row["gaps"], np.int32)
        local = pc.index_in(phrases.terms, value_set=row["terms"])
        self.local = np.asarray(pc.fill_null(local, -1)).astype(np.int64)
        self.rarity = np.where(self.local < 0, 0, counts[self.local]) if len(counts) else np.zeros(len(self.local), np.int64)
        self.lists: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        if term not in self.lists:
            at = self.local[term]
            self.lists[term] = np.cumsum(self.gaps[self.ends[at] - self.counts[at] : self.ends[at]], dtype=np.int64)
        return self.lists[term]

    def starts(self, window: np.ndarray, slop: int) -> np.ndarray:
        """Where the window occurs, rarest terms first."""
        order = np.argsort(self.rarity[window], kind="stable")
        if not len(order) or self.rarity[window[order[0]]] == 0:
            return np.zeros(0, np.int64)
        found = self.positions(window[order[0]]) - order[0]
        if slop:
            found = np.unique(found[:, None] + np.arange(-slop, slop + 1))
        for offset in order if slop else order[1:]:
            there = self.positions(window[offset]) - offset
            near = np.searchsorted(there, found - slop)
            hit = near < len(there)
            hit[hit] = there[near[hit]] <= found[hit] + slop
            found = found[hit]
            if not len(found):
                break
        return found


MATCHES = "shard string, at int, doc_id long, text_hash long, n_words long, spans array<struct<start:int,stop:int>>, items array<bigint>"
MATCHES_ARROW = pa.schema(
    [
        ("shard", pa.string()), ("at", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.int64())),
    ]
)


def shard_matches(row: dict, phrases: Phrases, slop: int) -> pa.RecordBatch:
    """Every document of a shard with its merged hit spans and the items that hit it."""
    reader = ShardReader(row, phrases)
    n_words = np.asarray(row["n_words"])
    begins = np.cumsum(n_words + 1) - n_words - 1
    spans: defaultdict[int, list] = defaultdict(list)
    items: defaultdict[int, set] = defaultdict(set)
    for k in phrases.among(reader.rarity > 0):
        window, owners = phrases.windows[k], phrases.owners[k]
        starts = reader.starts(window, slop)
        docs = np.searchsorted(begins, np.maximum(starts, 0), side="right") - 1
        for start, doc in zip(starts.tolist(), docs.tolist()):
            begin = int(begins[doc])
            low, high = start - slop - begin, start + len(window) + slop - begin
            if slop:
                # A window may only gather words of one document.
                low, high = max(low, 0), min(high, int(n_words[doc]))
                if not _inside(reader, window, start, slop, begin, begin + int(n_words[doc])):
                    continue
            spans[doc].append((low, high))
            items[doc].update(owners)
    merged = []
    for doc in range(len(n_words)):
        joined: list[list[int]] = []
        for low, high in sorted(spans.get(doc, ())):
            if joined and low <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([low, high])
        merged.append([{"start": a, "stop": b} for a, b in joined])
    found = [sorted(items.get(doc, ())) for doc in range(len(n_words))]
    columns = [[row["shard"]] * len(n_words), list(range(len(n_words))), row["doc_ids"], row["text_hashes"], n_words, merged, found]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MATCHES_ARROW)], schema=MATCHES_ARROW)


def _inside(reader: ShardReader, window: np.ndarray, start: int, slop: int, begin: int, end: int) -> bool:
    """Has every word an occurrence near its place that lies in [begin, end)?"""
    for offset, term in enumerate(window):
        low, high = max(start + offset - slop, begin), min(start + offset + slop, end - 1)
        there = reader.positions(term)
        near = np.searchsorted(there, low)
        if near == len(there) or there[near] > high:
            return False
    return True


def search(index: DataFrame, items: list[tuple[int | None, bytes | None]], window_words: int = WINDOW_WORDS, slop: int = 0) -> DataFrame:
    """Every indexed document with the spans and items of one bounded block of test texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window_words)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {f: batch.column(f)[k].as_py() for f in ("shard", "doc_ids", "text_hashes", "n_words", "counts", "gaps")}
                yield shard_matches(row | {"terms": batch.column("terms")[k].values}, phrases, slop)

    return index.mapInArrow(run, MATCHES)


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[int | None, bytes | None]], bool]]:
    """The distinct test texts (item_id, text), a bounded block after the other, and whether it is the last."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total) // block_bytes
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"].encode()) for r in own.orderBy("item_id", "text").collect()], k == n - 1


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, slop: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated: a row per row of `docs`."""
    index = build_index(docs, shard_bytes)
    found = None
    for block, last in blocks(items):
        part = search(index, block, window_words, slop)
        if not last or found is not None:
            # Written, so that the driver lets go of a block before it fetches the next.
            part = stored(part, "block-matches")
        found = part if found is None else found.unionByName(part)
    # One row per document and block of phrases.
    merged = found.groupBy("shard", "at").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    hits = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return merged.select(
        "doc_id", "text_hash", "n_words",
        F.size(F.array_distinct(hits)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """Rows of `docs` that share no window with any item; columns unchanged."""
    found = contamination(docs, items, window_words)
    return without(docs, stored(found.filter("contaminated").select("doc_id", "text_hash"), "contaminated"))
