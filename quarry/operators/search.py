"""Exact nearest-chunk search for tables of queries, by a scan of the chunks in scope.

Queries are answered block by block; a block is bounded by its vector entries or
tokens and sent to all tasks, chunks stay where they are. The driver holds one block at a time: the hits of a block
are written before the next one is fetched. A hybrid search scores both kinds of vectors in one scan.
For collections that are searched often, `search_index` writes indexes that read less. Chunks of projects that no
query of a block may see are filtered before they reach Python, so a collection that is partitioned by
project is pruned. Every task keeps only the best `pool` per query, so what is shuffled
grows with queries and tasks, never with query-chunk pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranking import top_n
from quarry.session import checkpoint

# Vector entries or tokens of a block of queries that is sent to every task.
MAX_SHARED_VALUES = 4_000_000
# Queries scored together, which bounds the size of a score matrix.
QUERY_BLOCK = 256
# Projects of a block that are listed in a filter; more of them are joined.
MAX_LISTED_PROJECTS = 1000
SCORE_CELLS = 4_000_000
SCORE_DIGITS = 12

HIT_SCHEMA = "kind INT, question_id STRING, query_no BIGINT, id STRING, score DOUBLE"
_HIT_FIELDS = pa.schema(
    [("kind", pa.int32()), ("question_id", pa.string()), ("query_no", pa.int64()), ("id", pa.string()), ("score", pa.float64())]
)


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.ListArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column) -> np.ndarray:
    """Equal-length float lists as a matrix."""
    lists = _flat(column)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


@dataclass
class _Queries:
    """Keys and scopes of a block of queries, and how to score chunks against it."""

    question_id: list[str]
    query_no: np.ndarray
    project_id: np.ndarray

    # Place of this kind of list among those of a hybrid search.
    kind = 0
    positive_only = False
    matrix = np.zeros((0, 0))

    @classmethod
    def read(cls, table: pa.Table) -> _Queries:
        self = cls(
            table["question_id"].to_pylist(),
            table["query_no"].to_numpy(zero_copy_only=False),
            table["project_id"].to_numpy(zero_copy_only=False),
        )
        self.prepare(table)
        return self

    def prepare(self, table: pa.Table) -> None:
        raise NotImplementedError

    def scores(self, chunks: pa.Table) -> np.ndarray:
        raise NotImplementedError

    def visible(self, projects: np.ndarray) -> np.ndarray:
        """Chunk by query: own project, and the base project for positive ones."""
        own = projects[:, None] == self.project_id[None, :]
        return own | ((projects == 0)[:, None] & (self.project_id > 0)[None, :])


class _DenseQueries(_Queries):
    def prepare(self, table: pa.Table) -> None:
        self.matrix = _matrix(table["embedding"]).T

    def scores(self, chunks: pa.Table) -> np.ndarray:
        # Rounded, so that equal vectors get equal scores wherever they stand.
        return np.round(_matrix(chunks["embedding"]) @ self.matrix, SCORE_DIGITS)


class _SparseQueries(_Queries):
    """Postings of the query tokens: for each token the queries and weights, in flat arrays."""

    kind = 1
    positive_only = True

    def prepare(self, table: pa.Table) -> None:
        tokens = _flat(table["tokens"])
        self.vocabulary = pc.unique(tokens.flatten())
        at = pc.index_in(tokens.flatten(), value_set=self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(at, kind="stable")
        self.query = tokens.value_parent_indices().to_numpy()[order]
        self.weight = _flat(table["weights"]).flatten().to_numpy(zero_copy_only=False)[order].astype(np.float64)
        self.sizes = np.bincount(at, minlength=len(self.vocabulary))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.matrix = np.zeros((0, len(table)))

    def scores(self, chunks: pa.Table) -> np.ndarray:
        tokens = _flat(chunks["tokens"])
        column = pc.index_in(tokens.flatten(), value_set=self.vocabulary)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        at = column.drop_null().to_numpy().astype(np.int64)
        rows = tokens.value_parent_indices().to_numpy()[known]
        own = _flat(chunks["weights"]).flatten().to_numpy(zero_copy_only=False)[known].astype(np.float64)
        sizes = self.sizes[at]
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[at], sizes)
        cells = np.repeat(rows, sizes) * self.matrix.shape[1] + self.query[place]
        shape = (len(chunks), self.matrix.shape[1])
        total = np.bincount(cells, np.repeat(own, sizes) * self.weight[place], shape[0] * shape[1])
        return np.round(total.reshape(shape), SCORE_DIGITS)


def _best(ids: np.ndarray, scores: np.ndarray, pool: int) -> np.ndarray:
    """Positions of the `pool` best scores, equal scores by id."""
    if len(scores) > pool:
        edge = np.partition(scores, len(scores) - pool)[len(scores) - pool]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:pool]


class _Leaders:
    """The best hits so far of every query of a block."""

    def __init__(self, queries: _Queries, pool: int):
        self.queries, self.pool = queries, pool
        empty = (np.array([], dtype=object), np.array([], dtype=np.float64))
        self.hits = [empty] * len(queries.question_id)

    def add(self, chunks: pa.Table, only: np.ndarray | None = None) -> None:
        """Score chunks against all queries of the block, or `only` some of them."""
        step = max(64, SCORE_CELLS // max(1, *self.queries.matrix.shape))
        for at in range(0, len(chunks), step):
            self._add(chunks.slice(at, step), only)

    def _add(self, chunks: pa.Table, only: np.ndarray | None) -> None:
        ids = np.array(chunks["id"].to_pylist(), dtype=object)
        visible = self.queries.visible(chunks["project_id"].to_numpy(zero_copy_only=False))
        scores = self.queries.scores(chunks)
        if self.queries.positive_only:
            visible &= scores > 0
        for q in range(len(self.hits)) if only is None else only:
            old_ids, old_scores = self.hits[q]
            rows = np.flatnonzero(visible[:, q])
            rows = rows[_best(ids[rows], scores[rows, q], self.pool)]
            if len(rows):
                all_ids = np.concatenate([old_ids, ids[rows]])
                all_scores = np.concatenate([old_scores, scores[rows, q]])
                keep = _best(all_ids, all_scores, self.pool)
                self.hits[q] = (all_ids[keep], all_scores[keep])

    def table(self) -> pa.Table:
        sizes = [len(ids) for ids, _ in self.hits]
        columns = [
            np.full(sum(sizes), self.queries.kind),
            np.repeat(np.array(self.queries.question_id, dtype=object), sizes),
            np.repeat(self.queries.query_no, sizes),
            np.concatenate([ids for ids, _ in self.hits]) if self.hits else [],
            np.concatenate([scores for _, scores in self.hits]) if self.hits else [],
        ]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _HIT_FIELDS)], schema=_HIT_FIELDS)


class _Scan:
    """Leaders of any number of queries, scored in blocks."""

    def __init__(self, readers: Sequence[type[_Queries]], queries: pa.Table, pool: int):
        starts = range(0, len(queries), QUERY_BLOCK)
        self.blocks = [_Leaders(reader.read(queries.slice(at, QUERY_BLOCK)), pool) for reader in readers for at in starts]

    def add(self, chunks: pa.Table) -> None:
        for block in self.blocks:
            block.add(chunks)

    def table(self) -> pa.Table:
        return pa.concat_tables([_HIT_FIELDS.empty_table(), *(block.table() for block in self.blocks)])


def _shared_search(chunks: DataFrame, block: pa.Table, readers: Sequence[type[_Queries]], pool: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Scan(readers, shared.value, pool)
        for batch in batches:
            best.add(pa.Table.from_batches([batch]))
        yield from best.table().to_batches()

    return chunks.mapInArrow(scan, HIT_SCHEMA)


def _in_scope(chunks: DataFrame, block: pa.Table) -> DataFrame:
    """Chunks that some query of the block may see: its projects, and project 0 for positive ones."""
    projects = set(block["project_id"].to_pylist()) - {None}
    if any(p > 0 for p in projects):
        projects.add(0)
    if len(projects) <= MAX_LISTED_PROJECTS:
        return chunks.filter(F.col("project_id").isin(*sorted(projects)))
    listed = chunks.sparkSession.createDataFrame([(p,) for p in sorted(projects)], "project_id BIGINT")
    return chunks.join(F.broadcast(listed), "project_id", "left_semi").select(*chunks.columns)


def query_blocks(queries: DataFrame, size: str, max_shared: int) -> Iterator[DataFrame]:
    """The queries in blocks of about `max_shared` entries of the list column `size`."""
    values = queries.agg(F.coalesce(F.sum(F.size(size)), F.lit(0))).first()[0]
    blocks = 1 + int(values) // max_shared
    for k in range(blocks):
        yield queries.filter(F.pmod(F.xxhash64("question_id", "query_no"), F.lit(blocks)) == k) if blocks > 1 else queries


def best_hits(hits: DataFrame, pool: int) -> DataFrame:
    """The first `pool` hits of every list, ranked; equal scores by id."""
    return top_n(hits, ["kind", "question_id", "query_no"], [F.col("score").desc(), F.col("id").asc()], pool, rank="rank")


def _search(
    chunks: DataFrame, queries: DataFrame, size: str, readers: Sequence[type[_Queries]], pool: int, max_shared: int
) -> DataFrame:
    parts, hits = list(query_blocks(queries, size, max_shared)), None
    for own in parts:
        block = own.toArrow()
        found = _shared_search(_in_scope(chunks, block), block, readers, pool)
        if len(parts) > 1:
            found = checkpoint(found)
        hits = found if hits is None else hits.unionByName(found)
    return best_hits(hits, pool)


def query_keys() -> list[Column]:
    return [F.col("question_id").cast("string"), F.col("query_no").cast("long"), F.col("project_id").cast("long")]


def chunk_keys() -> list[Column]:
    return [F.col("id").cast("string"), F.col("project_id").cast("long")]


def _weights() -> list[Column]:
    return [F.map_keys("sparse").alias("tokens"), F.map_values("sparse").alias("weights")]


def dense_search(chunks: DataFrame, queries: DataFrame, pool: int, max_shared: int = MAX_SHARED_VALUES) -> DataFrame:
    """Best `pool` chunks per query by inner product of unit vectors.

    `chunks`: `id, project_id, embedding`; `queries`: `question_id, query_no,
    project_id, embedding`. A query sees its project and, if positive, project 0.
    Returns `question_id, query_no, id, score, rank`. Fetches the queries while it is called.
    """
    chunks, queries = chunks.select(*chunk_keys(), "embedding"), queries.select(*query_keys(), "embedding")
    return _search(chunks, queries, "embedding", [_DenseQueries], pool, max_shared).drop("kind")


def sparse_search(chunks: DataFrame, queries: DataFrame, pool: int, max_shared: int = MAX_SHARED_VALUES) -> DataFrame:
    """As `dense_search` for `sparse` token-weight maps; only chunks that share a token."""
    chunks, queries = chunks.select(*chunk_keys(), *_weights()), queries.select(*query_keys(), *_weights())
    return _search(chunks, queries, "tokens", [_SparseQueries], pool, max_shared).drop("kind")


def hybrid_search(chunks: DataFrame, queries: DataFrame, pool: int, max_shared: int = MAX_SHARED_VALUES) -> DataFrame:
    """Both searches in one scan of the chunks; `kind` is 0 for dense lists and 1 for sparse ones."""
    chunks = chunks.select(*chunk_keys(), "embedding", *_weights())
    queries = queries.select(*query_keys(), "embedding", *_weights())
    return _search(chunks, queries, "embedding", [_DenseQueries, _SparseQueries], pool, max_shared)
