"""Hybrid retrieval for a table of questions: search, boost, fuse, floor, rerank.

After the search every frame is small: at most `pool` rows per ranked list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import cut, first_of, normalize_prefixes, strip, words
from quarry.operators.embedding import Embedder, embed
from quarry.operators.ranking import top_n
from quarry.operators.search import dense_search, hybrid_search
from quarry.operators.search_index import DenseIndex, SparseIndex
from quarry.session import checkpoint

# Ranking constants and cuts.
FILENAME_BOOST = 1.20
RRF_K = 60
MIN_DENSE_SCORE = 0.3
MIN_POOL = 40
TOP_K = 20
TOP_N = 5
PREVIEW_CHARS = 300

# Hits that may be sent to every task when names and texts are looked up.
MAX_SHARED_HITS = 500_000

Scorer = Callable[[Column, Column], Column]

# Fused scores are sums of doubles in no fixed order; equal ones must stay equal.
SCORE_DIGITS = 12

_LIST = ["question_id", "kind", "query_no"]


def boost_hits(hits: DataFrame, names: DataFrame, prefixes: DataFrame | None) -> DataFrame:
    """Multiply scores of chunks whose file name starts with a prefix of the question.

    `names` holds `(id, file_name)`, `prefixes` `(question_id, prefixes)`. Adds
    `raw_score` and `boosted`, and ranks every list again. Without prefixes the
    names are not read.
    """
    if prefixes is None:
        return hits.withColumns({"raw_score": F.col("score"), "boosted": F.lit(False)})
    named = names.select("id", "file_name").join(hits.withColumnRenamed("score", "raw_score"), "id")
    safe = prefixes.select("question_id", normalize_prefixes(F.col("prefixes")).alias("__prefixes"))
    upper = F.upper("file_name")
    starts = F.exists("__prefixes", lambda p: F.startswith(upper, p))
    boosted = F.coalesce(starts, F.lit(False))
    marked = named.join(safe, "question_id", "left").withColumn("boosted", boosted).drop("__prefixes")
    scored = marked.withColumn(
        "score", F.when(F.col("boosted"), F.col("raw_score") * FILENAME_BOOST).otherwise(F.col("raw_score"))
    )
    lists = [c for c in _LIST if c in scored.columns]
    again = Window.partitionBy(*lists).orderBy(F.col("score").desc(), F.col("rank"))
    return scored.withColumn("rank", F.row_number().over(again).cast("long"))


def fuse(hits: DataFrame, top_k: int, k: int = RRF_K, keep: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of all lists of a question.

    Ties go to the chunk seen first: dense lists before sparse ones, in query
    order, then by rank. The maxima of the `keep` columns are carried along.
    """
    seen = F.struct(*[c for c in ("kind", "query_no", "rank") if c in hits.columns])
    fused = hits.groupBy("question_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), SCORE_DIGITS).alias("score"),
        F.greatest(F.max("score"), F.lit(0.0)).alias("raw_score"),
        F.max("boosted").alias("boosted"),
        F.min(seen).alias("__seen"),
        *[F.max(c).alias(c) for c in keep],
    )
    best = [F.col("score").desc(), F.col("__seen").asc()]
    return top_n(fused, ["question_id"], best, top_k, rank="position").drop("__seen")


def word_overlap(question: Column, text: Column) -> Column:
    """Built-in scorer: share of the question's words that the text contains."""
    asked = words(question)
    return F.size(F.array_intersect(asked, words(text))) / F.greatest(F.size(asked), F.lit(1))


def guarded(score: Callable[[list[str], list[str]], Sequence[float]]) -> Scorer:
    """A scorer from a model call over (questions, texts); a batch for which it fails has no scores."""

    def scorer(question: Column, text: Column) -> Column:
        @F.pandas_udf("double")
        def scores(questions: pd.Series, texts: pd.Series) -> pd.Series:
            try:
                found = list(score(questions.tolist(), texts.tolist()))
            except Exception:  # candidates without a score keep their order
                found = []
            return pd.Series(found if len(found) == len(texts) else [None] * len(texts), dtype="float64")

        return scores(question, text)

    return scorer


def attach_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """`rerank_score` by position: `scores` holds (question_id, position, score) of a model's reply.

    Positions that no candidate has are dropped, of repeated ones the best score counts.
    """
    best = scores.groupBy("question_id", "position").agg(F.max("score").alias("rerank_score"))
    return candidates.join(best, ["question_id", "position"], "left")


def rerank(candidates: DataFrame, scorer: Scorer = word_overlap, top: int = TOP_N, chars: int | None = None) -> DataFrame:
    """Best `top` candidates per question by `scorer(question, text)`, of whole texts or their first `chars`.

    `candidates` holds `question_id, question, position, text`. Blank texts are
    dropped; candidates without a score keep their input order behind the rest.
    """
    filled = candidates.filter(F.length(strip(F.coalesce("text", F.lit("")))) > 0)
    score = scorer(F.col("question"), cut(F.col("text"), chars))
    scored = filled.withColumn("rerank_score", score)
    order = [F.col("rerank_score").desc_nulls_last(), F.col("position").asc()]
    return top_n(scored, ["question_id"], order, top, rank="source_no")


def source_rows(reranked: DataFrame, preview: int | None = PREVIEW_CHARS) -> DataFrame:
    """What is shown as sources: number, file, a preview of the text and the best score known."""
    return reranked.select(
        "question_id",
        "source_no",
        "id",
        "file_name",
        cut(F.col("text"), preview).alias("preview"),
        F.coalesce("rerank_score", "score", F.lit(0.0)).alias("score"),
    )


def context_block(chunks: DataFrame, keys: list[str], position: str, chars: int | None = None, keep: str | None = None) -> DataFrame:
    """`[n] (File: name) text` blocks of a short ranked list, joined by blank lines.

    `keep` names a boolean column; when it keeps nothing, everything is shown.
    """
    line = F.format_string(
        "[%d] (File: %s) %s", F.col(position), F.coalesce("file_name", F.lit("unknown")), cut(F.coalesce("text", F.lit("")), chars)
    )
    kept = F.col(keep) if keep else F.lit(True)
    entries = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), kept.alias("keep"), line.alias("line"))))
    lists = chunks.groupBy(*keys).agg(entries.alias("entries"))
    chosen = F.filter("entries", lambda e: e["keep"])
    shown = F.when(F.size(chosen) > 0, chosen).otherwise(F.col("entries"))
    return lists.select(*keys, F.array_join(F.transform(shown, lambda e: e["line"]), "\n\n").alias("block"))


# Collections --------------------------------------------------------------------
def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Stored form of chunks: whole, with an id from file and index."""
    return chunks.withColumn("id", F.concat_ws("_", F.col("file_id").cast("string"), F.col("chunk_index").cast("string")))


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot: the files that arrive replace all their old chunks."""
    files = incoming.select("file_id").distinct()
    return stored.join(files, "file_id", "left_anti").unionByName(incoming, allowMissingColumns=True)


# Retrieval ------------------------------------------------------------------------
def exploded_queries(questions: DataFrame, most: int | None = None) -> DataFrame:
    """`(question_id, query_no, project_id, text)`: the non-blank queries, or the first `most` of them."""
    filled = F.filter("queries", lambda q: F.length(strip(F.coalesce(q, F.lit("")))) > 0)
    asked = F.posexplode(first_of(filled, most)).alias("query_no", "text")
    return questions.select("question_id", "project_id", asked)


def retrieve(
    questions: DataFrame,
    index: DataFrame,
    embedder: Embedder,
    top_k: int = TOP_K,
    top: int = TOP_N,
    hybrid: bool = True,
    scorer: Scorer = word_overlap,
    indexes: tuple[DenseIndex, SparseIndex] | None = None,
) -> DataFrame:
    """The best chunks for every question. Runs jobs while it is called: queries are embedded, counted and searched.

    `questions`: `question_id, project_id, queries` (texts, the rewrite first)
    and optionally `prefixes` and `rerank_query`. `index`: stored chunks with
    `id, project_id, file_name, text, embedding, sparse`; it is scanned once for both vector
    kinds, and once for the names and texts of the hits. With `indexes` written over the same chunks, only
    what can still hold a hit is read.
    """
    # Queries are embedded once; the size of what follows is known from their number.
    vectors = checkpoint(embed(exploded_queries(questions), embedder))
    prefixes = questions.select("question_id", "prefixes") if "prefixes" in questions.columns else None
    if hybrid:
        pool = max(2 * top_k, MIN_POOL)
        hits = _both_kinds(indexes, vectors, pool) if indexes else hybrid_search(index, vectors, pool)
    else:
        pool = 4 * top_k
        hits = (indexes[0].search(vectors, pool) if indexes else dense_search(index, vectors, pool)).withColumn("kind", F.lit(0))
    if vectors.count() * 2 * pool <= MAX_SHARED_HITS:
        small = F.broadcast
    else:
        small = _unchanged
    names = index.select("id", "file_name")
    if hybrid:
        best = fuse(boost_hits(small(hits), names, prefixes), top_k).filter(F.col("score") > 0)
    else:
        best = _dense_only(hits, names, prefixes, vectors, top_k, small)
    asked = F.get(F.filter("queries", lambda q: F.length(strip(F.coalesce(q, F.lit("")))) > 0), 0)
    if "rerank_query" in questions.columns:
        asked = F.coalesce("rerank_query", asked)
    named = questions.select(F.col("question_id").cast("string"), asked.alias("question"))
    candidates = index.select("id", "file_name", "text").join(small(best), "id").join(named, "question_id")
    return rerank(candidates, scorer, top)


def _both_kinds(indexes: tuple[DenseIndex, SparseIndex], vectors: DataFrame, pool: int) -> DataFrame:
    dense, sparse = (index.search(vectors, pool).withColumn("kind", F.lit(k)) for k, index in enumerate(indexes))
    return dense.unionByName(sparse)


def _unchanged(df: DataFrame) -> DataFrame:
    return df


def _dense_only(
    hits: DataFrame,
    names: DataFrame,
    prefixes: DataFrame | None,
    vectors: DataFrame,
    top_k: int,
    small: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """One query: its list with a score floor. Several: fused lists of twice the depth.

    A list is first cut by raw score to twice its depth where prefixes are
    given, then boosted and cut to its depth.
    """
    asked = vectors.groupBy(F.col("question_id").cast("string").alias("question_id")).agg(F.count(F.lit(1)).alias("asked"))
    several = F.col("asked") > 1
    pooled = hits.join(asked, "question_id").withColumn("depth", F.when(several, 2 * top_k).otherwise(top_k))
    factor = F.lit(1)
    if prefixes is not None:
        usable = prefixes.select("question_id", (F.size(normalize_prefixes(F.col("prefixes"))) > 0).alias("boostable"))
        pooled = pooled.join(usable, "question_id", "left")
        factor = F.when(F.coalesce("boostable", F.lit(False)), 2).otherwise(1)
    pooled = pooled.filter(F.col("rank") <= factor * F.col("depth"))
    ranked = boost_hits(small(pooled), names, prefixes).filter(F.col("rank") <= F.col("depth"))
    # A single list is one that fusion keeps in order; only its score differs.
    alone = F.when(several, F.lit(None)).otherwise(F.col("score"))
    fused = fuse(ranked.withColumn("alone", alone), top_k, keep=["alone"])
    scored = fused.withColumn("score", F.coalesce("alone", "score"))
    floor = F.when(F.col("alone").isNotNull(), F.col("score") >= MIN_DENSE_SCORE).otherwise(F.col("score") > 0)
    return scored.filter(floor).drop("alone")
