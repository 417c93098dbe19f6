"""Queries over chunks, vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators import catalog, ingest, retrieval, search, search_index
from quarry.operators.chunking import register_sql, semantic_chunks
from quarry.operators.embedding import HashedWords, embed, sparse_rows
from quarry.operators.ranking import top_n
from quarry.plans.registry import query
from quarry.plans.tables import FILES, sql_round
from quarry.session import checkpoint, scratch_path, spread
from quarry.sources.snapshots import KeyedFolders

DIMS = 64


def _last(mark: str) -> str:
    """0-based position of the last `mark` in `head`, -1 without one."""
    back = f"strpos(reverse(head), reverse({mark}))"
    return f"(CASE WHEN {back} = 0 THEN -1 ELSE length(head) - {back} - length({mark}) + 1 END)"


_MARKS = ("'. '", "'! '", "'? '", "chr(10)", "'; '", "', '")
_CUT = " ".join(f"WHEN {_last(m)} > 750 THEN {_last(m)} + length({m})" for m in _MARKS)

CHUNKS = f"""{FILES},
cuts AS (
  SELECT file_id, 0 AS step, '' AS piece, trim(text, E' \\n') AS rest FROM files
  UNION ALL
  SELECT file_id, step + 1, substring(rest, 1, cut), substring(rest, cut - 199)
  FROM (SELECT file_id, step, rest, CASE {_CUT} ELSE 1500 END AS cut
        FROM (SELECT *, substring(rest, 1, 1550) AS head FROM cuts WHERE length(rest) > 2250))),
pieces AS (
  SELECT file_id, step, trim(piece, E' \\n') AS text FROM cuts WHERE step > 0
  UNION ALL
  SELECT file_id, max(step) + 1, trim(arg_max(rest, step), E' \\n') FROM cuts GROUP BY 1),
kept AS (
  SELECT p.file_id, p.text, min(step) AS step FROM pieces p JOIN files f USING (file_id)
  WHERE length(p.text) > 0 GROUP BY 1, 2),
chunks AS (
  SELECT file_id, project_id, file_name, kept.text, row_number() OVER (PARTITION BY file_id ORDER BY step) - 1 AS chunk_index,
         CAST(file_id AS VARCHAR) || '_' || CAST(row_number() OVER (PARTITION BY file_id ORDER BY step) - 1 AS VARCHAR) AS id
  FROM kept JOIN files USING (file_id))
"""


def _tokens(name: str, source: str, key: str) -> str:
    """Word counts, and hashed word vectors scaled to unit length."""
    return f"""
{name}_words AS (
  SELECT {key}, w AS token, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS w FROM {source}) GROUP BY ALL),
{name}_buckets AS (
  SELECT {key}, CAST(('0x' || substring(md5(token), 1, 7)) AS BIGINT) % {DIMS} AS b, sum(weight) AS n FROM {name}_words GROUP BY ALL),
{name}_dense AS (
  SELECT {key}, b, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS x FROM {name}_buckets)"""


@query(
    "chunk_documents",
    f"WITH RECURSIVE {CHUNKS} SELECT file_id, chunk_index, length(text) AS chars, md5(text) AS text_md5 FROM chunks",
)
def _chunk_documents(data):
    return data.chunks().select("file_id", "chunk_index", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query(
    "embed_sparse",
    f"WITH {_tokens('d', 'documents', 'doc_id')} SELECT doc_id, token, weight FROM d_words",
)
def _embed_sparse(data):
    vectors = embed(spread(data.table("documents").select("doc_id", "text")), HashedWords(DIMS))
    return sparse_rows(vectors, ["doc_id"]).withColumn("weight", F.col("weight").cast("double"))


@query(
    "embed_dense",
    f"""
    WITH {_tokens('d', 'documents', 'doc_id')}
    SELECT doc_id, b AS dim, {sql_round("CAST(x AS DOUBLE)", 5)} AS x FROM d_dense WHERE x > 0
    """,
)
def _embed_dense(data):
    vectors = embed(spread(data.table("documents").select("doc_id", "text")), HashedWords(DIMS), sparse=False)
    long = vectors.select("doc_id", F.posexplode_outer("embedding").alias("dim", "x")).filter("x > 0")
    return long.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 5).alias("x"))


SENTENCES = f"""
parts AS (
  SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(regexp_replace(trim(text, E' \\n'), '([.!?;])\\s+', '\\1\x01', 'g'), '\\n{{2,}}', '\x01', 'g'), '\x01'),
    lambda x: trim(x, E' \\n')), lambda x: length(x) > 0) AS s FROM documents WHERE length(text) > 1500),
sents AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS pos, len(s) AS n FROM parts WHERE len(s) > 3),
{_tokens('s', 'sents', 'doc_id, pos').strip()},
unit AS (SELECT doc_id, pos, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, pos)) AS x FROM s_buckets),
dots AS (SELECT l.doc_id, l.pos, sum(l.x * r.x) AS dot FROM unit l JOIN unit r ON l.doc_id = r.doc_id AND r.pos = l.pos + 1 AND l.b = r.b GROUP BY 1, 2),
dist AS (SELECT doc_id, pos, round(1 - coalesce(dot, 0), 6) AS d FROM sents LEFT JOIN dots USING (doc_id, pos) WHERE pos < n),
ranks AS (SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS m FROM dist),
limits AS (SELECT doc_id, d AS top FROM ranks WHERE r = floor(0.92 * (m - 1))),
steps AS (SELECT doc_id, pos, length(text) + 1 AS size, pos = n AS last, coalesce(d >= top, false) AS far
          FROM sents JOIN limits USING (doc_id) LEFT JOIN dist USING (doc_id, pos)),
walk AS (
  SELECT doc_id, pos, 0 AS chunk, size AS len, last OR size >= 1500 OR (far AND size >= 50) AS cut FROM steps WHERE pos = 1
  UNION ALL
  SELECT doc_id, pos, chunk, len, last OR len >= 1500 OR (far AND len >= 50) FROM (
    SELECT t.doc_id, t.pos, chunk + CASE WHEN cut THEN 1 ELSE 0 END AS chunk, CASE WHEN cut THEN 0 ELSE len END + size AS len, last, far
    FROM walk w JOIN steps t ON t.doc_id = w.doc_id AND t.pos = w.pos + 1)),
joined AS (SELECT doc_id, chunk, string_agg(text, ' ' ORDER BY pos) AS text FROM walk JOIN sents USING (doc_id, pos) GROUP BY 1, 2),
semantic AS (SELECT doc_id, text, min(chunk) AS chunk FROM joined WHERE length(text) > 0 GROUP BY 1, 2),
all_chunks AS (
  SELECT doc_id, text, chunk FROM semantic
  UNION ALL
  SELECT file_id, text, chunk_index FROM chunks WHERE file_id NOT IN (SELECT doc_id FROM semantic))
"""


@query(
    "semantic_chunks",
    f"""
    WITH RECURSIVE {CHUNKS}, {SENTENCES}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS chunk_index, md5(text) AS text_md5 FROM all_chunks
    """,
)
def _semantic_chunks(data):
    chunks = semantic_chunks(spread(data.table("documents").select("doc_id", "text")), ["doc_id"], HashedWords(DIMS))
    return chunks.select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


@query(
    "chunk_upsert",
    f"""
    WITH RECURSIVE {CHUNKS}
    SELECT id, 'old' AS origin FROM chunks WHERE project_id >= 10
    UNION ALL SELECT CAST(doc_id AS VARCHAR) || '_0', 'new' FROM documents WHERE CAST(substr(source, 4) AS BIGINT) < 10
    """,
)
def _chunk_upsert(data):
    """Files of the first ten projects arrive again with one chunk each."""
    stored = retrieval.chunk_rows(data.chunks()).withColumn("origin", F.lit("old"))
    arriving = data.files().filter("project_id < 10").select(
        "file_id", "project_id", "file_name", "text", F.lit(0).cast("long").alias("chunk_index")
    )
    incoming = retrieval.chunk_rows(arriving).withColumn("origin", F.lit("new"))
    return retrieval.upsert_chunks(stored, incoming).select("id", "origin")


@query(
    "chunk_upsert_stored",
    f"""
    WITH RECURSIVE {CHUNKS}
    SELECT id, 'old' AS origin FROM chunks WHERE project_id >= 10 AND file_id % 50 <> 49
    UNION ALL SELECT CAST(doc_id AS VARCHAR) || '_0', 'new' FROM documents WHERE CAST(substr(source, 4) AS BIGINT) < 10
    """,
)
def _chunk_upsert_stored(data):
    """The same over a stored collection, after every fiftieth file was deleted: only folders of changed files are written."""
    old = retrieval.chunk_rows(data.chunks()).select("file_id", "id", F.lit("old").alias("origin"))
    arriving = data.files().filter("project_id < 10").select("file_id", F.lit(0).cast("long").alias("chunk_index"))
    new = retrieval.chunk_rows(arriving).select("file_id", "id", F.lit("new").alias("origin"))
    table = KeyedFolders(data.spark, scratch_path(data.spark, "collection"), "file_id BIGINT, id STRING, origin STRING", "file_id")
    table.replace(old)
    table.delete(data.files().select("file_id").filter("file_id % 50 = 49"))
    table.replace(new)
    return table.read().select("id", "origin")


@query(
    "ingest_status",
    f"""
    WITH RECURSIVE {CHUNKS}, n AS (SELECT file_id, count(*) AS chunks FROM chunks GROUP BY 1),
    s AS (SELECT f.file_id, coalesce(chunks, 0) AS chunks, CASE
            WHEN file_type NOT IN ('pdf', 'md', 'txt', 'docx') THEN 'unsupported file type'
            WHEN length(trim(text, E' \\n')) < 1 THEN 'no extractable text'
            WHEN coalesce(chunks, 0) = 0 THEN 'no usable chunks' END AS error FROM files f LEFT JOIN n USING (file_id))
    SELECT file_id, CASE WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS status,
           CASE WHEN error IS NULL THEN chunks ELSE 0 END AS chunks_count, error FROM s
    """,
)
def _ingest_status(data):
    counts = data.chunks().groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    files = data.files().withColumn("file_bytes", F.octet_length("text"))
    return catalog.ingest_status(files, counts)


@query(
    "rebuild_index",
    f"""
    WITH RECURSIVE {CHUNKS}, n AS (SELECT file_id, count(*) AS chunks FROM chunks GROUP BY 1)
    SELECT project_id, count(*) FILTER (WHERE coalesce(chunks, 0) > 0) AS ok, count(*) FILTER (WHERE coalesce(chunks, 0) = 0) AS failed,
           CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks
    FROM files LEFT JOIN n USING (file_id) WHERE process_status = 'ready' GROUP BY 1
    """,
)
def _rebuild_index(data):
    """Chunk and embed all ready files again, write them, and report per project."""
    return ingest.rebuild_index(data.files(), HashedWords(DIMS), lambda rows: _written(data, rows))


@query(
    "ingest_files",
    f"""
    WITH RECURSIVE {CHUNKS}, n AS (SELECT file_id, count(*) AS chunks FROM chunks GROUP BY 1),
    s AS (SELECT f.file_id, coalesce(chunks, 0) AS chunks, CASE
            WHEN file_type NOT IN ('pdf', 'md', 'txt', 'docx') THEN 'unsupported file type'
            WHEN length(trim(text, E' \\n')) < 1 THEN 'no extractable text' END AS error FROM files f LEFT JOIN n USING (file_id))
    SELECT file_id, CASE WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS status,
           CASE WHEN error IS NULL THEN chunks ELSE 0 END AS chunks_count, CASE WHEN error IS NULL THEN chunks ELSE 0 END AS stored FROM s
    """,
)
def _ingest_files(data):
    """The whole job over all files; what was stored is counted from what was written."""
    files = data.files().withColumn("file_bytes", F.octet_length("text"))
    done = ingest.ingest_files(files, HashedWords(DIMS), lambda rows: _written(data, rows))
    stored = done.chunks.groupBy("file_id").agg(F.count("embedding").alias("stored"))
    return done.status.drop("error").join(stored, "file_id", "left").fillna({"stored": 0})


@query(
    "chunk_sql",
    f"WITH RECURSIVE {CHUNKS} SELECT file_id, chunk_index, md5(text) AS text_md5 FROM chunks",
)
def _chunk_sql(data):
    """The chunker as a table function of SQL."""
    register_sql(data.spark)
    data.table("documents").select("doc_id", "text").createOrReplaceTempView("quarry_chunk_input")
    return data.spark.sql(
        "SELECT doc_id AS file_id, c.chunk_index, md5(c.chunk) AS text_md5 FROM quarry_chunk_input, LATERAL chunk_text(text, 1500, 200) c"
    )


@query(
    "chunk_sql_table",
    f"WITH RECURSIVE {CHUNKS} SELECT file_id, chunk_index, md5(text) AS text_md5 FROM chunks",
)
def _chunk_sql_table(data):
    """The chunker as a table function over a whole table, in Arrow batches."""
    register_sql(data.spark)
    data.table("documents").select("doc_id", "text").createOrReplaceTempView("quarry_chunk_input")
    return data.spark.sql(
        "SELECT id AS file_id, chunk_index, md5(chunk) AS text_md5 FROM chunk_table(TABLE(SELECT doc_id, text FROM quarry_chunk_input), 1500, 200)"
    )


@query(
    "rerank_guarded",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS source_no FROM conversations",
)
def _rerank_guarded(data):
    """A scorer that always fails leaves the candidates in their order."""

    def broken(questions, texts):
        raise ValueError("no model")

    candidates = data.table("conversations").select(F.col("conv_id").alias("question_id"), F.lit("q").alias("question"), F.col("turn").alias("position"), "text")
    best = retrieval.rerank(candidates, retrieval.guarded(broken), top=1000)
    return best.select(F.col("question_id").alias("conv_id"), F.col("position").alias("turn"), "source_no")


@query(
    "scores_by_position",
    """
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(length(text) AS DOUBLE) END AS score FROM conversations
    """,
)
def _scores_by_position(data):
    """Scores for every other position, once more with a lower value, and for positions that do not exist."""
    said = data.table("conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("position"), "text")
    given = said.filter("position % 2 = 0").select("question_id", "position", F.length("text").cast("double").alias("score"))
    worse = given.withColumn("score", F.col("score") - 1)
    beyond = given.withColumn("position", F.col("position") + 1000)
    found = retrieval.attach_scores(said, given.unionByName(worse).unionByName(beyond))
    return found.select(F.col("question_id").alias("conv_id"), F.col("position").alias("turn"), F.col("rerank_score").alias("score"))


# Dense search over the given vectors ------------------------------------------------
VECTORS = """
points AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS BIGINT) AS project_id, vec_id, embedding,
         ['EN', 'FR', 'DE'][vec_id % 3 + 1] || '_' || CAST(vec_id AS VARCHAR) || '.txt' AS file_name FROM embeddings),
values_ AS (SELECT project_id, vec_id % 4 AS query_no, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM points),
centres AS (SELECT project_id, query_no, d, avg(CAST(x AS DOUBLE)) AS x FROM values_ GROUP BY 1, 2, 3),
asked AS (
  SELECT CAST(project_id AS VARCHAR) AS question_id, project_id, query_no, list(CAST(x AS FLOAT) ORDER BY d) AS q FROM centres GROUP BY 1, 2, 3),
pairs AS (
  SELECT question_id, query_no, id, file_name, list_sum(list_transform(generate_series(1, len(q)),
           lambda i: CAST(q[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS score
  FROM asked a JOIN points p ON p.project_id = a.project_id OR (a.project_id > 0 AND p.project_id = 0)),
pool AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, query_no ORDER BY score DESC, id) AS rank FROM pairs)
  WHERE rank <= 40)
"""


def _points(data):
    vec = F.col("vec_id")
    name = F.concat(F.get(F.array(*[F.lit(x) for x in ("EN", "FR", "DE")]), (vec % 3).cast("int")), F.lit("_"), vec.cast("string"), F.lit(".txt"))
    return data.table("embeddings").select(
        vec.cast("string").alias("id"), F.col("label").cast("long").alias("project_id"), name.alias("file_name"), "vec_id", "embedding"
    )


def _centres(data):
    """Four queries per label: mean vectors of the label's points, dealt by id."""
    values = _points(data).select("project_id", (F.col("vec_id") % 4).alias("query_no"), F.posexplode("embedding").alias("d", "x"))
    means = values.groupBy("project_id", "query_no", "d").agg(F.avg(F.col("x").cast("double")).cast("float").alias("x"))
    # One entry per vector dimension.
    vector = F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"])
    queries = means.groupBy("project_id", "query_no").agg(vector.alias("embedding"))
    return queries.withColumn("question_id", F.col("project_id").cast("string"))


@query(
    "dense_topk",
    f"WITH {VECTORS} SELECT question_id, query_no, id, rank, {sql_round('score', 6)} AS score FROM pool WHERE rank <= 20",
)
def _dense_topk(data):
    hits = search.dense_search(_points(data), _centres(data), 20)
    return hits.select("question_id", "query_no", "id", "rank", F.round("score", 6).alias("score"))


@query(
    "dense_topk_indexed",
    f"WITH {VECTORS} SELECT question_id, query_no, id, rank, {sql_round('score', 6)} AS score FROM pool WHERE rank <= 20",
)
def _dense_topk_indexed(data):
    """The rows of the scan, through a written coarse quantiser."""
    index = search_index.write_dense_index(_points(data), scratch_path(data.spark, "dense-index"))
    hits = index.search(checkpoint(_centres(data)), 20)
    return hits.select("question_id", "query_no", "id", "rank", F.round("score", 6).alias("score"))


BOOSTED = f"""{VECTORS},
boosted AS (SELECT question_id, query_no, id, rank AS old_rank, file_name LIKE 'FR#_%' ESCAPE '#' AS boosted,
                   CASE WHEN file_name LIKE 'FR#_%' ESCAPE '#' THEN score * 1.2 ELSE score END AS score FROM pool),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, query_no ORDER BY score DESC, old_rank) AS rank FROM boosted)
"""


def _boosted_hits(data):
    points = _points(data)
    centres = _centres(data)
    hits = search.dense_search(points, centres, 40).withColumn("kind", F.lit(0))
    prefixes = centres.select("question_id").distinct().withColumn("prefixes", F.array(F.lit("fr"), F.lit("not ok!")))
    return retrieval.boost_hits(hits, points, prefixes)


@query(
    "boosted_topk",
    f"WITH {BOOSTED} SELECT question_id, query_no, id, rank, boosted, {sql_round('score', 6)} AS score FROM ranked WHERE rank <= 20",
)
def _boosted_topk(data):
    top = _boosted_hits(data).filter("rank <= 20")
    return top.select("question_id", "query_no", "id", "rank", "boosted", F.round("score", 6).alias("score"))


@query(
    "rrf",
    f"""
    WITH {BOOSTED},
    fused AS (SELECT question_id, id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 12) AS score, greatest(max(score), 0) AS raw_score,
                     bool_or(boosted) AS boosted, min(query_no * 1000 + rank) AS seen FROM ranked GROUP BY 1, 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS position FROM fused)
    SELECT question_id, id, position, boosted, {sql_round("score", 8)} AS score, {sql_round("raw_score", 6)} AS raw_score
    FROM f WHERE position <= 20
    """,
)
def _rrf(data):
    fused = retrieval.fuse(_boosted_hits(data), 20)
    return fused.select(
        "question_id", "id", "position", "boosted", F.round("score", 8).alias("score"), F.round("raw_score", 6).alias("raw_score")
    )


# Sparse search and full retrieval over chunks -----------------------------------------
QUESTIONS = """
asked AS (
  SELECT CAST(item_id AS VARCHAR) AS question_id, item_id % 20 AS project_id, text,
         list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, E' \\n')), lambda s: length(s) > 0) AS parts FROM benchmark),
exploded AS (
  SELECT question_id, project_id, unnest(list_concat([text], parts)) AS text,
         generate_subscripts(list_concat([text], parts), 1) - 1 AS query_no FROM asked),
queries AS (SELECT question_id, query_no, project_id, text FROM exploded WHERE length(text) > 0)
"""

HYBRID = f"""{CHUNKS}, {QUESTIONS}, {_tokens('c', 'chunks', 'id')}, {_tokens('q', 'queries', 'question_id, query_no')},
scope AS (SELECT question_id, query_no, q.project_id AS asked, c.id FROM queries q
          JOIN chunks c ON c.project_id = q.project_id OR (q.project_id > 0 AND c.project_id = 0)),
dense_hits AS (
  SELECT s.question_id, s.query_no, 0 AS kind, s.id, coalesce(d.score, 0) AS score FROM scope s LEFT JOIN (
    SELECT question_id, query_no, id, sum(CAST(q.x AS DOUBLE) * CAST(c.x AS DOUBLE)) AS score
    FROM q_dense q JOIN c_dense c USING (b) GROUP BY 1, 2, 3) d USING (question_id, query_no, id)),
sparse_hits AS (
  SELECT s.question_id, s.query_no, 1 AS kind, s.id, score FROM scope s JOIN (
    SELECT question_id, query_no, id, sum(q.weight * c.weight) AS score
    FROM q_words q JOIN c_words c USING (token) GROUP BY 1, 2, 3) d USING (question_id, query_no, id)),
lists AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, kind, query_no ORDER BY round(score, 12) DESC, id) AS rank
  FROM (SELECT * FROM dense_hits UNION ALL SELECT * FROM sparse_hits)),
pool AS (SELECT * FROM lists WHERE rank <= 40)
"""


def _questions(data):
    """Benchmark texts as questions: the text, then its sentences."""
    parts = F.filter(F.transform(F.split("text", r"\."), strip), lambda s: F.length(s) > 0)
    return data.table("benchmark").select(
        F.col("item_id").cast("string").alias("question_id"),
        (F.col("item_id") % 20).alias("project_id"),
        F.concat(F.array("text"), parts).alias("queries"),
    )


def _embedded_chunks(data):
    return retrieval.chunk_rows(embed(data.chunks(), HashedWords(DIMS)))


def _written(data, rows):
    """Chunks in the shared folder, in folders by project, so that a search reads its projects only."""
    path = scratch_path(data.spark, "index")
    rows.write.partitionBy("project_id").parquet(path)
    return data.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def _index(data):
    """All chunks with both vectors, written once to the shared folder."""
    return _written(data, _embedded_chunks(data))


@query(
    "sparse_topk",
    f"""
    WITH RECURSIVE {HYBRID} SELECT question_id, query_no, id, rank, score FROM lists WHERE kind = 1 AND rank <= 20
    """,
)
def _sparse_topk(data):
    queries = embed(retrieval.exploded_queries(_questions(data)), HashedWords(DIMS))
    return search.sparse_search(_embedded_chunks(data), queries, 20).select("question_id", "query_no", "id", "rank", "score")


@query(
    "sparse_topk_indexed",
    f"""
    WITH RECURSIVE {HYBRID} SELECT question_id, query_no, id, rank, score FROM lists WHERE kind = 1 AND rank <= 20
    """,
)
def _sparse_topk_indexed(data):
    """The rows of the scan, through a written inverted index."""
    queries = embed(retrieval.exploded_queries(_questions(data)), HashedWords(DIMS))
    index = search_index.write_sparse_index(_embedded_chunks(data), scratch_path(data.spark, "sparse-index"))
    return index.search(queries, 20).select("question_id", "query_no", "id", "rank", "score")


@query(
    "multi_query",
    f"""
    WITH RECURSIVE {HYBRID} SELECT question_id, query_no, CAST(kind AS BIGINT) AS kind, id, rank, {sql_round("score", 5)} AS score FROM pool
    """,
)
def _multi_query(data):
    # Read twice below, so the model runs once.
    queries = checkpoint(embed(retrieval.exploded_queries(_questions(data)), HashedWords(DIMS)))
    index = _index(data)
    hits = search.hybrid_search(index, queries, 40)
    return hits.select("question_id", "query_no", F.col("kind").cast("long").alias("kind"), "id", "rank", F.round("score", 5).alias("score"))


RERANKED = f"""{HYBRID},
fused AS (SELECT question_id, id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 12) AS score,
                 min(kind * 1000000 + query_no * 1000 + rank) AS seen FROM pool GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS position FROM fused) WHERE position <= 20),
word_sets AS (
  SELECT t.*, c.file_name, c.text, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda w: length(w) > 0)) AS qw,
         list_distinct(list_filter(regexp_split_to_array(lower(c.text), '\\s+'), lambda w: length(w) > 0)) AS cw
  FROM top t JOIN chunks c USING (id) JOIN asked a USING (question_id)),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, position) AS source_no
  FROM (SELECT *, len(list_intersect(qw, cw)) / greatest(len(qw), 1) AS rerank_score FROM word_sets))
"""


@query(
    "retrieve",
    f"""
    WITH RECURSIVE {RERANKED}
    SELECT question_id, source_no, id, position, {sql_round("rerank_score", 6)} AS rerank_score FROM reranked WHERE source_no <= 5
    """,
)
def _retrieve(data):
    best = retrieval.retrieve(_questions(data), _index(data), HashedWords(DIMS))
    return best.select("question_id", "source_no", "id", "position", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "retrieve_indexed",
    f"""
    WITH RECURSIVE {RERANKED}
    SELECT question_id, source_no, id, position, {sql_round("rerank_score", 6)} AS rerank_score FROM reranked WHERE source_no <= 5
    """,
)
def _retrieve_indexed(data):
    index = _index(data)
    dense = search_index.write_dense_index(index, scratch_path(data.spark, "dense-index"))
    sparse = search_index.write_sparse_index(index, scratch_path(data.spark, "sparse-index"))
    best = retrieval.retrieve(_questions(data), index, HashedWords(DIMS), indexes=(dense, sparse))
    return best.select("question_id", "source_no", "id", "position", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "rag_sources",
    f"""
    WITH RECURSIVE {RERANKED}
    SELECT question_id, source_no, id, file_name, substring(text, 1, 300) AS preview, {sql_round("rerank_score", 6)} AS score
    FROM reranked WHERE source_no <= 5
    """,
)
def _rag_sources(data):
    best = retrieval.retrieve(_questions(data), _index(data), HashedWords(DIMS))
    return retrieval.source_rows(best).withColumn("score", F.round("score", 6))


@query(
    "context_block",
    f"""
    WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY length(text) DESC, file_id) AS n FROM files)
    SELECT project_id, md5(string_agg('[' || CAST(n AS VARCHAR) || '] (File: ' || file_name || ') ' || text, E'\\n\\n' ORDER BY n)
             FILTER (WHERE n % 2 = 1)) AS block_md5
    FROM r WHERE n <= 5 GROUP BY 1
    """,
)
def _context_block(data):
    """The longest five files per project as context, every other one kept."""
    order = [F.length("text").desc(), F.col("file_id").asc()]
    top = top_n(data.files(), ["project_id"], order, 5, rank="n").withColumn("useful", F.col("n") % 2 == 1)
    blocks = retrieval.context_block(top, ["project_id"], "n", keep="useful")
    return blocks.select("project_id", F.md5("block").alias("block_md5"))


@query(
    "rerank",
    f"""
    WITH d AS (
      SELECT c.conv_id, c.turn, c.text, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '\\s+'), lambda w: length(w) > 0)) AS qw,
             list_distinct(list_filter(regexp_split_to_array(lower(c.text), '\\s+'), lambda w: length(w) > 0)) AS cw
      FROM conversations c JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1) q USING (conv_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS source_no
          FROM (SELECT *, len(list_intersect(qw, cw)) / greatest(len(qw), 1) AS score FROM d))
    SELECT conv_id, turn, source_no, {sql_round("score", 6)} AS score FROM r WHERE source_no <= 5
    """,
)
def _rerank(data):
    """Messages of a conversation ranked against its first one."""
    said = data.table("conversations")
    first = top_n(said, ["conv_id"], [F.col("turn").asc()], 1).select("conv_id", F.col("text").alias("question"))
    candidates = said.join(first, "conv_id").select(F.col("conv_id").alias("question_id"), "question", F.col("turn").alias("position"), "text")
    best = retrieval.rerank(candidates)
    return best.select(
        F.col("question_id").alias("conv_id"), F.col("position").alias("turn"), "source_no", F.round("rerank_score", 6).alias("score")
    )
