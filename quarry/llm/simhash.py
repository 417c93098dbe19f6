"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits; a bit is set if it is set in more than half of the
text's shingle hashes. Equal fingerprints are reduced to one row first. Links between different
fingerprints at most `max_bits` apart are found in three steps:

1. Pairs are brought together by blocks: the bits are cut into `max_bits` + 1 parts,
   and two linked fingerprints agree in at least one. Distances to any reference
   are close to 32 for nearly all fingerprints, so the pivot tables alone could not
   deal the pairs to tasks. A cell (fingerprints that agree in some bits) above
   `CELL_ROWS` is cut again by the same rule on its other bits, which loses no link
   and bounds every cell.
2. The distances of every fingerprint to `PIVOTS` reference fingerprints are computed
   once per cell. Distances of a linked pair to any reference differ by at
   most `max_bits`, so pairs with a larger coordinate difference are discarded:
   rows are sorted by the first coordinate, only neighbours in its window are
   looked at, and the other coordinates are compared one after the other.
3. The true Hamming distance of the survivors is checked. A cell returns a spanning
   forest of its links, never its pairs.

Defined results: a null text, an empty text and a text of white space have no
shingles and the fingerprint zero, which links like any other. Repeated rows and
repeated ids are kept; a component's id is the smallest id that is not null. Equal fingerprints are
always linked. Very long texts are taken word by word, in blocks, whole. An empty table has no rows. Extra columns are
kept by `keep_one`, whatever their names, and ignored by the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import free_name, small, stored, text_key, without, words_in
from quarry.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
PIVOTS = 24
CELL_ROWS = 4096
# Rows of cells per task, and pairs looked at together.
TASK_ROWS = 400_000
PAIRS_AT_ONCE = 1 << 20
# Shingle hashes whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(raw: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a whole text."""
    # Bytes know only A-Z and the six ASCII white-space characters.
    words = iter(words_in((raw or b"").lower()))
    part = list(islice(words, BLOCK + shingle_words - 1))
    if not part:
        return 0
    n, ones, digest = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while part:
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle_words)))) if len(part) >= shingle_words else [b" ".join(part)]
        hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
        more = list(islice(words, BLOCK))
        part = part[len(part) - shingle_words + 1 :] + more if more else []
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) per row of `docs`; fp is the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def signed(texts: pa.Array) -> pa.Array:
        found = [fingerprint(raw, shingle_words) for raw in texts.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return docs.select(*text_key(F.col("doc_id"), F.col("text")), signed(F.col("text").cast("string")).alias("fp"))


def split_bits(mask: int, parts: int) -> list[int]:
    """The set bits of `mask` cut into `parts` masks of nearly equal size."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[k * len(bits) // parts : (k + 1) * len(bits) // parts]) for k in range(parts)]


def as_signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints spread over all bit patterns."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(n)], np.uint64)


def linked_pairs(cell: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of one cell at most `max_bits` apart, each once, in bounded portions."""
    table = np.stack([np.bitwise_count(fps ^ p) for p in pivots()], axis=1).astype(np.int64)
    # Cells stay apart, as coordinates are at most 64.
    place = np.unique(cell, return_inverse=True)[1] * 256 + table[:, 0]
    order = np.argsort(place, kind="stable")
    fps, table, place = fps[order], table[order].astype(np.int8), place[order]
    sizes = np.searchsorted(place, place + max_bits, side="right") - np.arange(len(fps)) - 1
    pairs, start = np.cumsum(sizes), 0
    while start < len(fps):
        done = pairs[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(pairs, done + PAIRS_AT_ONCE, side="right")))
        own = sizes[start:stop]
        left = np.repeat(np.arange(start, stop), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        for k in range(1, table.shape[1]):
            near = np.abs(table[left, k] - table[right, k]) <= max_bits
            left, right = left[near], right[near]
        near = np.bitwise_count(fps[left] ^ fps[right]) <= max_bits
        yield order[left[near]], order[right[near]]
        start = stop


def forest(cell: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the cells, as positions."""
    root, edges = np.arange(len(fps)), []
    for lefts, rights in linked_pairs(cell, fps, max_bits):
        for start in range(0, len(lefts), 4096):
            a, b = root[lefts[start : start + 4096]], root[rights[start : start + 4096]]
            apart = a != b
            for i, j in zip(a[apart].tolist(), b[apart].tolist()):
                while root[i] != i:
                    i = int(root[i])
                while root[j] != j:
                    j = int(root[j])
                if i != j:
                    root[max(i, j)] = min(i, j)
                    edges.append((i, j))
            while not np.array_equal(root, root[root]):
                root = root[root]
    found = np.array(edges, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def cells(fps: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(mask, value, fp): fingerprints by the bits they share, cells of at least two and at most `cell_rows`.

    A cell that is too large is cut by `max_bits` + 1 groups of the bits it does not
    share yet. This ends: with n bits left a cell has at most 2**n rows.
    """

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        """Each row once per sub-mask of its own mask."""
        deeper = F.create_map(
            *[x for m in masks for x in (F.lit(as_signed(m)), F.array(*[F.lit(as_signed(m | p)) for p in split_bits(~m & (1 << 64) - 1, max_bits + 1)]))]
        )
        return rows.select("fp", F.explode(deeper[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))

    masks, ready = [0], None
    rows = dealt(fps.select("fp", F.lit(0).cast("long").alias("mask")), masks)
    while True:
        masks = sorted({m | p for m in masks for p in split_bits(~m & (1 << 64) - 1, max_bits + 1)})
        sizes = stored(rows.groupBy("mask", "value").count().filter("count > 1"), "simhash-sizes")
        fit = sizes.filter(F.col("count") <= cell_rows).select("mask", "value")
        part = rows.join(small(fit), ["mask", "value"], "left_semi").select("mask", "value", "fp")
        ready = part if ready is None else ready.unionByName(part)
        hot = sizes.filter(F.col("count") > cell_rows).select("mask", "value")
        if hot.isEmpty():
            return ready
        hot_rows = rows.join(small(hot), ["mask", "value"], "left_semi")
        rows = stored(dealt(hot_rows, masks).distinct(), "simhash-cells")


def link_task(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Forests of the cells of one task, whose rows come sorted by cell."""
    mask = value = fps = np.zeros(0, np.int64)

    def edges(cut: int) -> pa.RecordBatch:
        cell = np.cumsum((np.diff(mask[:cut], prepend=0) != 0) | (np.diff(value[:cut], prepend=0) != 0))
        a, b = forest(cell, fps[:cut].view(np.uint64), max_bits)
        return pa.RecordBatch.from_pydict({"a": fps[a], "b": fps[b]})

    for batch in batches:
        mask, value, fps = (np.concatenate([old, batch.column(k).to_numpy()]) for k, old in enumerate((mask, value, fps)))
        # The last cell may go on in the next batch.
        cut = int(np.argmax((mask == mask[-1]) & (value == value[-1]))) if len(mask) else 0
        if cut:
            yield edges(cut)
            mask, value, fps = mask[cut:], value[cut:], fps[cut:]
    if len(mask):
        yield edges(len(mask))


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of all links between distinct fingerprints `fp`."""
    # Dealt to a number of tasks of its own: rows are few bytes but much work.
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, 1 + (max_bits + 1) * fps.count() // TASK_ROWS)
    dealt = cells(fps, max_bits, cell_rows).repartition(tasks, "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(lambda batches: link_task(batches, max_bits), "a long, b long")


def components(found: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`found` (doc_id, fp, ...) with `component_id`, the smallest doc_id reachable over links,
    and `group`, one of the fingerprints of the component."""
    owners = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-owners")
    edges = stored(links(owners.select("fp"), max_bits, cell_rows), "simhash-links")
    named = connected_components(edges).select(F.col("node").alias("fp"), "component")
    joined = owners.join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = joined.select("fp", "component").join(least, "component").select("fp", "component_id", F.col("component").alias("group"))
    return found.join(ids, "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, group), a row per row of `docs`."""
    found = stored(fingerprints(docs, shingle_words), "simhash-fingerprints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return components(found, max_bits).select("doc_id", "text_hash", hexed.alias("fingerprint"), "component_id", "group")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest id; columns unchanged.

    If that id is repeated inside its group, the row with the least text hash stays,
    and one of those that are equal in id and text. A group without any id keeps one row.
    """
    found = stored(near_duplicates(docs, shingle_words, max_bits), "simhash-groups")
    at_least = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Repeats of the winning id only; usually one row a group.
    winners = at_least.groupBy("group", "doc_id", "text_hash").count()
    first = F.row_number().over(Window.partitionBy("group").orderBy("text_hash"))
    winners = stored(winners.withColumn("rank", first).filter("rank = 1"), "simhash-winners")
    losers = found.join(winners.select("doc_id", "text_hash").alias("w"), (found["doc_id"].eqNullSafe(F.col("w.doc_id"))) & (found["text_hash"] == F.col("w.text_hash")), "left_anti")
    kept = without(docs, losers)
    repeated = winners.filter("count > 1").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return kept
    id_, hash_ = text_key(F.col("doc_id"), F.col("text"))
    key_id, key_hash = free_name(docs, "key_id"), free_name(docs, "key_hash")
    keys = small(repeated.select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash)))
    repeats = kept.join(keys, F.col(key_id).eqNullSafe(id_) & (F.col(key_hash) == hash_), "left_semi")
    return without(kept, repeated).unionByName(repeats.dropDuplicates(["doc_id", "text"]))
