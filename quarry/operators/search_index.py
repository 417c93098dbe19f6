"""Written indexes for chunk search that are exact, and read only what can still hold a hit.

Dense: a coarse quantiser. Centres are trained by k-means in Spark on a bounded sample; every chunk is stored in the
folder of its nearest centre. For a query q and a list with centre c and radius R, no chunk of the list scores more than
q.c + |q| R. The most promising lists of each query are scanned first; their worst kept score is a
floor, and of the other lists only those whose bound reaches it are scanned. With `probes` only that many lists
are scanned per query, which is approximate.

Sparse: an inverted index. Chunks are numbered in blocks of neighbours (same project, same strongest token). A token
has one row per block that holds it: its largest and smallest weight there. Rows are in folders by
token hash, so a search reads the folders of its tokens only. The extremes bound what a block can give to a query. The
chunks of the best blocks are scanned first, then those of blocks whose bound reaches the floor.

Both return the rows of `dense_search` and `sparse_search`. Queries and chunks see each other by
project as there. Indexes are built and searched while the functions are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ranking import top_n
from quarry.operators.search import (
    HIT_SCHEMA, MAX_SHARED_VALUES, QUERY_BLOCK, SCORE_CELLS, _DenseQueries, _in_scope, _Leaders, _matrix, _search, _SparseQueries, best_hits, chunk_keys,
    query_blocks, query_keys,
)
from quarry.session import checkpoint

# Chunks that centres are trained on at most (about), rounds of k-means, lists at most.
SAMPLE_ROWS, ROUNDS, MAX_LISTS = 100_000, 10, 4096
# Share of the lists that is scanned first.
FIRST_SHARE, FIRST_LISTS = 0.05, 4
# Chunks of a block, folders of tokens, and blocks scored first per hit wanted.
BLOCK_BITS, TOKEN_FOLDERS, FIRST_BLOCKS = 6, 64, 0.5
# Slack for sums in another order; scores are rounded at SCORE_DIGITS.
SLACK = 1e-9


# Dense ------------------------------------------------------------------------------
def _bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Query by list: no chunk of the list has a larger score."""
    return queries @ centres.T + np.linalg.norm(queries, axis=1, keepdims=True) * radii


def _nearest(vectors: np.ndarray, centres: np.ndarray, cells: int = SCORE_CELLS) -> np.ndarray:
    """The nearest centre of every vector; so many pairs are scored at a time, however many of either there are."""
    half = np.square(centres).sum(axis=1) / 2
    near, step = np.zeros(len(vectors), np.int64), max(1, cells // max(1, len(centres)))
    for at in range(0, len(vectors), step):
        near[at : at + step] = (vectors[at : at + step] @ centres.T - half).argmax(axis=1)
    return near


def _trained_centres(chunks: DataFrame, lists: int | None, sample_rows: int, rounds: int) -> np.ndarray:
    rows = chunks.count()
    wanted = lists or min(MAX_LISTS, max(1, round(rows**0.5)))
    every = max(1, -(-rows // sample_rows))
    sample = chunks.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    if not sample.head(1):
        return np.zeros((0, 0))
    model = KMeans(k=wanted, featuresCol="v", maxIter=rounds, seed=1).fit(sample) if wanted > 1 else None
    if model is None:
        return np.zeros((1, len(sample.first()["v"])))
    return np.array(model.clusterCenters(), np.float64)


@dataclass(frozen=True)
class DenseIndex:
    """Chunks in folders by list, and the centre and radius of every list."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray

    def search(self, queries: DataFrame, pool: int, probes: int | None = None, max_shared: int = MAX_SHARED_VALUES) -> DataFrame:
        """Best `pool` chunks per query, exactly; or with `probes`, the best of the so many most promising lists."""
        queries = queries.select(*query_keys(), "embedding")
        parts, hits = list(query_blocks(queries, "embedding", max_shared)), None
        for own in parts:
            found = self._block(own.toArrow(), pool, probes)
            hits = found if hits is None else hits.unionByName(found)
        return best_hits(hits, pool).drop("kind")

    def _block(self, block: pa.Table, pool: int, probes: int | None) -> DataFrame:
        lists = len(self.radii)
        first = max(1, min(lists, probes or max(FIRST_LISTS, round(lists * FIRST_SHARE))))
        matrix = _matrix(block["embedding"]) if len(block) and lists else np.zeros((len(block), 0))
        reach = np.full(len(block), -np.inf)
        for at in range(0, len(block) if lists else 0, QUERY_BLOCK):
            bounds = _bounds(matrix[at : at + QUERY_BLOCK], self.centres, self.radii)
            reach[at : at + QUERY_BLOCK] = np.partition(bounds, lists - first, axis=1)[:, lists - first]
        near = self._scan(block, pool, reach, np.full(len(block), np.inf))
        if probes is not None or first >= lists:
            return near
        near = checkpoint(near)
        kept = best_hits(near, pool).groupBy("question_id", "query_no").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        # At most a row per query of the block.
        floors = {(r["question_id"], r["query_no"]): r["least"] for r in kept.filter(F.col("n") >= pool).collect()}
        keys = zip(block["question_id"].to_pylist(), block["query_no"].to_pylist())
        floor = np.array([floors.get(k, -np.inf) for k in keys]) - SLACK
        rest = self._scan(block, pool, floor, reach + SLACK)
        # A list on the edge may be scanned twice.
        return checkpoint(near.unionByName(rest).dropDuplicates(["kind", "question_id", "query_no", "id"]))

    def lists_in_reach(self, block: pa.Table, least: np.ndarray, below: np.ndarray) -> list[int]:
        """Lists whose bound for any query of the block is in the query's range; only their folders are read."""
        wanted = np.zeros(len(self.radii), bool)
        for at in range(0, len(block) if len(wanted) else 0, QUERY_BLOCK):
            own = slice(at, at + QUERY_BLOCK)
            bounds = _bounds(_matrix(block["embedding"].slice(at, QUERY_BLOCK)), self.centres, self.radii)
            wanted |= ((bounds >= least[own, None]) & (bounds < below[own, None])).any(axis=0)
        return np.flatnonzero(wanted).tolist()

    def _scan(self, block: pa.Table, pool: int, least: np.ndarray, below: np.ndarray) -> DataFrame:
        """Hits in the lists whose bound for a query is at least `least` and under `below`."""
        lists = self.lists_in_reach(block, least, below)
        shared = self.rows.sparkSession.sparkContext.broadcast((block, least, below, self.centres, self.radii))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, least, below, centres, radii = shared.value
            starts = range(0, len(block), QUERY_BLOCK)
            parts = [(_Leaders(_DenseQueries.read(block.slice(at, QUERY_BLOCK)), pool), slice(at, at + QUERY_BLOCK)) for at in starts]
            for batch in batches:
                numbers = batch.column("list").to_numpy(zero_copy_only=False)
                for number in np.unique(numbers):
                    chunks = pa.Table.from_batches([batch]).filter(pa.array(numbers == number))
                    for leaders, own in parts:
                        bound = _bounds(leaders.queries.matrix.T, centres[[number]], radii[[number]])[:, 0]
                        asking = np.flatnonzero((bound >= least[own]) & (bound < below[own]))
                        if len(asking):
                            leaders.add(chunks, asking)
            for leaders, _ in parts:
                yield from leaders.table().to_batches()

        rows = self.rows.filter(F.col("list").isin(*lists)) if lists else self.rows.filter(F.lit(False))
        return _in_scope(rows, block).select("id", "project_id", "embedding", "list").mapInArrow(scan, HIT_SCHEMA)


def write_dense_index(
    chunks: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS
) -> DenseIndex:
    """Index every row of `chunks` (id, project_id, embedding) in `path`.

    Centres are fitted on a share of the rows by hash of the id, about `sample_rows` at most; there are `lists` of them, by
    default the root of the number of chunks.
    """
    spark = chunks.sparkSession
    used = chunks.select(*chunk_keys(), "embedding")
    centres = _trained_centres(used, lists, sample_rows, rounds)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            vectors = _matrix(batch.column(2))
            near = _nearest(vectors, centres)
            away = np.linalg.norm(vectors - centres[near], axis=1) if len(vectors) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=["id", "project_id", "embedding", "list", "away"])

    kind = chunks.schema["embedding"].dataType.simpleString()
    placed = used.mapInArrow(assign, f"id string, project_id long, embedding {kind}, list int, away double")
    # Rows of a list go together; AQE cuts lists that are too large for one task.
    together = placed.hint("rebalance", "list").sortWithinPartitions("list", "project_id")
    together.write.partitionBy("list").parquet(f"{path}/rows")
    radii = spark.read.schema("away double, list int").parquet(f"{path}/rows").groupBy("list").agg(F.max("away").alias("radius"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    table.join(radii, "list").write.parquet(f"{path}/lists")
    return read_dense_index(spark, path, kind)


def read_dense_index(spark: SparkSession, path: str, kind: str = "array<float>") -> DenseIndex:
    """An index as it was written; at most `MAX_LISTS` centres come to the driver."""
    rows = spark.read.schema(f"id string, project_id long, embedding {kind}, list int").parquet(f"{path}/rows")
    lists = {r["list"]: r for r in spark.read.schema("list int, centre array<double>, radius double").parquet(f"{path}/lists").collect()}
    size = max(lists, default=-1) + 1
    dims = len(next(iter(lists.values()))["centre"]) if lists else 0
    centres, radii = np.zeros((size, dims)), np.full(size, -np.inf)
    for number, row in lists.items():
        centres[number], radii[number] = row["centre"], row["radius"] + SLACK
    return DenseIndex(rows, centres, radii)


# Sparse -----------------------------------------------------------------------------
EXTREMES = "token string, project_id long, block long, largest double, smallest double, folder int"
CHUNKS = "id string, project_id long, sparse map<string, double>, block long"


@dataclass(frozen=True)
class SparseIndex:
    """The extremes of every token by block of chunks, and the chunks by block."""

    rows: DataFrame
    chunks: DataFrame

    def search(self, queries: DataFrame, pool: int, first_share: float = FIRST_BLOCKS) -> DataFrame:
        """Best `pool` chunks per query among those that share a token, exactly."""
        asked = checkpoint(queries.select(*query_keys(), F.explode("sparse").alias("token", "asked")).withColumn("asked", F.col("asked").cast("double")))
        tokens = self._of(asked)
        gives = F.greatest(F.col("asked") * F.col("largest"), F.col("asked") * F.col("smallest"), F.lit(0.0))
        keys = ["question_id", "query_no"]
        seen = tokens.select("token", F.col("project_id").alias("own"), "block", "largest", "smallest")
        bounds = seen.join(asked, "token").filter(_visible(F.col("own"), F.col("project_id"))).groupBy(*keys, "own", "block").agg(F.sum(gives).alias("bound"))
        first = max(1, round(pool * first_share))
        best = [F.col("bound").desc(), F.col("block").asc(), F.col("own").asc()]
        bounds = checkpoint(bounds.filter(F.col("bound") > 0))
        early = checkpoint(top_n(bounds, keys, best, first))
        words = F.collect_list(F.struct("token", "asked")).alias("words")
        lists = asked.groupBy(*keys, "project_id").agg(words)
        lists = lists.select(*keys, "project_id", F.col("words.token").alias("tokens"), F.col("words.asked").alias("weights"))
        scan = lambda chunks: _search(chunks, lists, "tokens", [_SparseQueries], pool, MAX_SHARED_VALUES).drop("rank")
        near = checkpoint(scan(self._scored(early, asked, tokens)))
        floors = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= pool)
        late = bounds.join(early.select(*keys, "own", "block"), [*keys, "own", "block"], "left_anti").join(floors, keys, "left")
        late = late.filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK).select(*keys, "own", "block")
        # A chunk is scored for all queries at once, so for some of them twice.
        hits = near.unionByName(scan(self._scored(checkpoint(late), asked, tokens))).distinct()
        return best_hits(hits, pool).drop("kind")

    def _of(self, asked: DataFrame) -> DataFrame:
        """Rows in the folders that hold the tokens asked for; there are few folders."""
        folders = [r["folder"] for r in asked.select(_folder(F.col("token")).alias("folder")).distinct().collect()]
        return self.rows.filter(F.col("folder").isin(*folders)) if folders else self.rows.filter(F.lit(False))

    def _scored(self, blocks: DataFrame, asked: DataFrame, tokens: DataFrame) -> DataFrame:
        """The chunks that are scored: all in `blocks`, which `asked` has found by `tokens`. No posting is shuffled."""
        held = self.chunks.join(blocks.select("block").distinct(), "block", "left_semi")
        return held.select("id", "project_id", F.map_keys("sparse").alias("tokens"), F.map_values("sparse").alias("weights"))


def _visible(own: Column, asking: Column) -> Column:
    return (own == asking) | ((own == 0) & (asking > 0))


def _folder(token: Column, folders: int = TOKEN_FOLDERS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(folders)).cast("int")


def _each_once(chunks: DataFrame) -> DataFrame:
    """Chunks (id, project_id, sparse) with the weights of equal ids of a project added up; only these are shuffled."""
    keys = ["project_id", "id"]
    several = checkpoint(chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*(F.col(k).alias(f"__{k}") for k in keys)))
    if not several.head(1):
        return chunks
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    weights = chunks.join(several, same, "left_semi").select(*keys, F.explode("sparse").alias("token", "weight"))
    summed = weights.groupBy(*keys, "token").agg(F.sum("weight").alias("weight"))
    merged = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("sparse"))
    return chunks.join(several, same, "left_anti").unionByName(merged)


def write_sparse_index(chunks: DataFrame, path: str, block_bits: int = BLOCK_BITS) -> SparseIndex:
    """Index every row of `chunks` (id, project_id, sparse) in `path`, in blocks of 2 ** block_bits chunks."""
    spark = chunks.sparkSession
    # Written before they are put in order, which reads them twice; models run once.
    used = chunks.select(*chunk_keys(), F.col("sparse").cast("map<string, double>").alias("sparse"))
    used.write.option("compression", "zstd").parquet(f"{path}/chunks")
    placed = _each_once(spark.read.schema(used.schema).parquet(f"{path}/chunks"))
    strongest = F.array_max(F.transform(F.map_entries("sparse"), lambda e: F.struct(e["value"].alias("w"), e["key"].alias("t"))))["t"]
    placed = placed.withColumn("strongest", strongest)
    in_order = placed.repartitionByRange("project_id", "strongest", "id").sortWithinPartitions("project_id", "strongest", "id")
    # Numbers depend on how rows were dealt out, so they are written before anything is derived from them.
    numbered = in_order.withColumn("block", F.shiftright(F.monotonically_increasing_id(), block_bits)).drop("strongest")
    numbered.write.option("compression", "zstd").parquet(f"{path}/blocks")
    rows = spark.read.schema(CHUNKS).parquet(f"{path}/blocks").select("project_id", "block", F.explode("sparse").alias("token", "weight"))
    extremes = rows.groupBy("token", "project_id", "block").agg(F.max("weight").alias("largest"), F.min("weight").alias("smallest"))
    together = extremes.withColumn("folder", _folder(F.col("token"))).hint("rebalance", "folder").sortWithinPartitions("folder", "token")
    together.write.partitionBy("folder").option("compression", "zstd").parquet(f"{path}/extremes")
    return read_sparse_index(spark, path)


def read_sparse_index(spark: SparkSession, path: str) -> SparseIndex:
    return SparseIndex(spark.read.schema(EXTREMES).parquet(f"{path}/extremes"), spark.read.schema(CHUNKS).parquet(f"{path}/blocks"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits that were found, over all queries."""
    keys = ["question_id", "query_no", "id"]
    both = exact.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    row = both.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
