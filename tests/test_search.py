import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval, search, search_index
from quarry.operators.embedding import HashedWords, embed
from quarry.operators.search import dense_search, hybrid_search, sparse_search
from quarry.operators.search_index import read_dense_index, recall, write_dense_index, write_sparse_index

RNG = np.random.default_rng(4)
N, Q, DIMS, POOL = 400, 9, 8, 7


def unit(n):
    x = RNG.normal(size=(n, DIMS)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points(spark):
    vectors = unit(N)
    vectors[50:60] = vectors[40:50]  # equal scores are settled by id
    words = [f"w{i}" for i in range(30)]
    sparse = [{w: float(RNG.integers(1, 5)) for w in RNG.choice(words, 6, replace=False)} for _ in range(N)]
    projects = [int(p) for p in RNG.choice([0, 1, 1, 1, 2, -3], N)]
    data = [(f"c{i:03d}", projects[i], vectors[i].tolist(), sparse[i]) for i in range(N)]
    schema = "id STRING, project_id BIGINT, embedding ARRAY<FLOAT>, sparse MAP<STRING, FLOAT>"
    return data, spark.createDataFrame(data, schema).repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    vectors = unit(Q)
    data = [
        (f"q{i // 3}", i % 3, [1, 0, -3][i // 3], vectors[i].tolist(), {f"w{i}": 1.0, f"w{i + 9}": 2.0, "zzz": 9.0})
        for i in range(Q)
    ]
    schema = "question_id STRING, query_no INT, project_id BIGINT, embedding ARRAY<FLOAT>, sparse MAP<STRING, FLOAT>"
    return data, spark.createDataFrame(data, schema)


def brute_force(points, asked, score, positive):
    want = {}
    for question, no, project, vector, words in asked:
        hits = []
        for id_, own, v, s in points:
            if own == project or (project > 0 and own == 0):
                x = score(vector, v, words, s)
                if x > 0 or not positive:
                    hits.append((-round(x, 9), id_))
        want[(question, no)] = [id_ for _, id_ in sorted(hits)[:POOL]]
    return want


def got_lists(hits):
    out = {}
    for r in hits.orderBy("rank").collect():
        out.setdefault((r.question_id, r.query_no), []).append(r.id)
    return out


@pytest.mark.parametrize("max_shared", [10**6, 20], ids=["one block", "blocks"])
def test_dense_search_is_exact(points, asked, max_shared):
    want = brute_force(points[0], asked[0], lambda q, v, *_: float(np.dot(np.float64(np.float32(q)), np.float64(np.float32(v)))), False)
    assert got_lists(dense_search(points[1], asked[1], POOL, max_shared)) == want


@pytest.mark.parametrize("max_shared", [10**6, 20], ids=["one block", "blocks"])
def test_sparse_search_is_exact(points, asked, max_shared):
    score = lambda _q, _v, w, s: sum(x * s.get(t, 0.0) for t, x in w.items())
    want = {k: v for k, v in brute_force(points[0], asked[0], score, True).items() if v}
    assert got_lists(sparse_search(points[1], asked[1], POOL, max_shared)) == want


def test_hybrid_search_gives_both_lists_in_one_scan(points, asked):
    hits = hybrid_search(points[1], asked[1], POOL)
    assert got_lists(hits.filter("kind = 0")) == got_lists(dense_search(points[1], asked[1], POOL))
    assert got_lists(hits.filter("kind = 1")) == got_lists(sparse_search(points[1], asked[1], POOL))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("lists", [1, 7, 40, None])
@pytest.mark.parametrize("max_shared", [10**6, 20], ids=["one block", "blocks"])
def test_dense_index_gives_the_rows_of_the_scan(points, asked, tmp_path, lists, max_shared):
    index = write_dense_index(points[1], str(tmp_path / "dense"), lists)
    assert index.rows.count() == N
    want = dense_search(points[1], asked[1], POOL).collect()
    assert sorted(index.search(asked[1], POOL, max_shared=max_shared).collect()) == sorted(want)


def test_dense_index_reads_fewer_lists_where_chunks_cluster(spark, tmp_path, monkeypatch):
    centres = unit(40)
    near = np.repeat(centres, 50, axis=0) + RNG.normal(scale=0.01, size=(2000, DIMS))
    rows = [(f"c{i}", 1, v.tolist()) for i, v in enumerate(near)]
    chunks = spark.createDataFrame(rows, "id string, project_id long, embedding array<float>")
    queries = spark.createDataFrame([("q", i, 1, c.tolist()) for i, c in enumerate(centres[:6])], "question_id string, query_no int, project_id long, embedding array<float>")
    index = write_dense_index(chunks, str(tmp_path / "dense"), 40)
    read, reach = [], type(index).lists_in_reach
    monkeypatch.setattr(type(index), "lists_in_reach", lambda self, *range_: read.append(reach(self, *range_)) or read[-1])
    assert got_lists(index.search(queries, 10)) == got_lists(dense_search(chunks, queries, 10))
    assert len(read) == 2 and len({*read[0], *read[1]}) < 30
    found = index.search(queries.limit(1), 10, probes=1)
    assert len(read[2]) == 1 and "list#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1][:200]
    assert recall(index.search(queries, 10, probes=3), dense_search(chunks, queries, 10)) >= 0.9


def test_dense_index_is_read_back(points, asked, tmp_path, spark):
    write_dense_index(points[1], str(tmp_path / "dense"), 5)
    again = read_dense_index(spark, str(tmp_path / "dense"))
    assert got_lists(again.search(asked[1], POOL)) == got_lists(dense_search(points[1], asked[1], POOL))
    none = write_dense_index(points[1].filter("id = 'no'"), str(tmp_path / "none"))
    assert none.search(asked[1], POOL).count() == 0
    assert again.search(asked[1].filter("query_no > 9"), POOL).count() == 0


@pytest.mark.parametrize("bits", [0, 3, 6])
def test_sparse_index_gives_the_rows_of_the_scan(points, asked, tmp_path, bits):
    index = write_sparse_index(points[1], str(tmp_path / "sparse"), bits)
    want = sparse_search(points[1], asked[1], POOL).collect()
    for share in (0.2, 5.0):
        assert sorted(index.search(asked[1], POOL, share).collect()) == sorted(want)


def test_sparse_index_with_negative_weights_is_exact(spark, tmp_path):
    words = [f"w{i}" for i in range(12)]
    rows = [(f"c{i:03d}", i % 3, {w: float(RNG.integers(-4, 5)) for w in RNG.choice(words, 4, replace=False)}) for i in range(200)]
    chunks = spark.createDataFrame(rows, "id string, project_id long, sparse map<string, float>")
    asked = [("q", i, i % 2, {w: float(RNG.integers(-3, 4)) for w in RNG.choice(words, 5, replace=False)}) for i in range(8)]
    queries = spark.createDataFrame(asked, "question_id string, query_no int, project_id long, sparse map<string, float>")
    index = write_sparse_index(chunks, str(tmp_path / "sparse"), 2)
    assert sorted(index.search(queries, 5).collect()) == sorted(sparse_search(chunks, queries, 5).collect())


def test_sparse_index_reads_the_folders_of_its_tokens_and_skips_blocks(spark, tmp_path, monkeypatch):
    rows = [(f"c{i:04d}", 0, {f"topic{i % 40}": 1.0 + i % 7, "the": 0.1}) for i in range(2000)]
    chunks = spark.createDataFrame(rows, "id string, project_id long, sparse map<string, float>")
    queries = spark.createDataFrame([("q", 0, 0, {"topic3": 2.0, "the": 1.0})], "question_id string, query_no int, project_id long, sparse map<string, float>")
    index = write_sparse_index(chunks, str(tmp_path / "sparse"), 3)
    scored, plain = [], type(index)._scored

    def watched(self, blocks, asked, tokens):
        scored.append((blocks.count(), tokens.select("folder").distinct().count()))
        return plain(self, blocks, asked, tokens)

    monkeypatch.setattr(type(index), "_scored", watched)
    assert got_lists(index.search(queries, 10)) == got_lists(sparse_search(chunks, queries, 10))
    blocks = index.rows.select("block").distinct().count()
    assert sum(n for n, _ in scored) < blocks / 5
    assert scored[0][1] == 2 < index.rows.select("folder").distinct().count()


def test_retrieve_with_indexes_gives_the_same(spark, library, tmp_path):
    indexes = write_dense_index(library, str(tmp_path / "dense")), write_sparse_index(library, str(tmp_path / "sparse"))
    for queries, project in ((["bank profit", "weather"], 5), (["profit"], 0), (["bank"], -6)):
        question = ask(spark, queries, project)
        want = retrieval.retrieve(question, library, HashedWords(64)).collect()
        assert sorted(retrieval.retrieve(question, library, HashedWords(64), indexes=indexes).collect()) == sorted(want)


def test_only_projects_in_scope_are_read(points, asked, tmp_path, spark):
    path = str(tmp_path / "collection")
    points[1].write.partitionBy("project_id").parquet(path)
    found = dense_search(spark.read.parquet(path), asked[1].filter("project_id = -3"), POOL)
    scan = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "project_id" in scan and "-3" in scan and "IN (-3,0" not in scan
    want = {k: v for k, v in got_lists(dense_search(points[1], asked[1], POOL)).items() if k[0] == "q2"}
    assert got_lists(found) == want


def test_many_sparse_queries_take_memory_by_their_tokens():
    n, tokens = 20_000, 20
    words = RNG.integers(0, 50_000, (n, tokens))
    table = pa.table(
        {
            "question_id": [str(i) for i in range(n)], "query_no": np.zeros(n, np.int64), "project_id": np.ones(n, np.int64),
            "tokens": pa.array([[f"w{w}" for w in row] for row in words]), "weights": pa.array(np.ones((n, tokens)).tolist()),
        }
    )
    queries = search._SparseQueries.read(table)
    held = sum(x.nbytes for x in (queries.query, queries.weight, queries.sizes, queries.starts, queries.matrix))
    assert held < 40 * n * tokens


def test_search_with_nothing_to_find(points, asked):
    none = points[1].filter("project_id = 77")
    assert dense_search(none, asked[1], POOL).count() == 0
    assert sparse_search(points[1], asked[1].filter("query_no > 5"), POOL).count() == 0


def test_fusion_sums_ranks_and_breaks_ties_by_first_list(spark):
    hits = [
        ("q", 0, 0, "a", 0.9, False, 1), ("q", 0, 0, "b", 0.8, True, 2),
        ("q", 1, 0, "b", 5.0, False, 1), ("q", 1, 0, "a", 4.0, False, 2),
        ("q", 1, 1, "c", -1.0, False, 1),
    ]
    schema = "question_id STRING, kind INT, query_no INT, id STRING, score DOUBLE, boosted BOOLEAN, rank BIGINT"
    df = spark.createDataFrame(hits, schema)
    got = [(r.id, r.position, r.raw_score, r.boosted) for r in retrieval.fuse(df, 3).orderBy("position").collect()]
    assert got == [("a", 1, 4.0, False), ("b", 2, 5.0, True), ("c", 3, 0.0, False)]
    again = retrieval.fuse(df.orderBy(F.rand(1)), 3).orderBy("position")
    assert [r.id for r in again.collect()] == ["a", "b", "c"]


def test_rerank_without_scores_keeps_the_input_order(spark):
    data = [("q", "x y", 1, "y"), ("q", "x y", 2, " "), ("q", "x y", 3, "x y"), ("q", "x y", 4, None)]
    df = spark.createDataFrame(data, "question_id STRING, question STRING, position INT, text STRING")
    best = retrieval.rerank(df, top=5).orderBy("source_no")
    assert [(r.position, r.rerank_score) for r in best.collect()] == [(3, 1.0), (1, 0.5)]
    failed = retrieval.rerank(df, lambda q, t: F.lit(None).cast("double"), top=5).orderBy("source_no")
    assert [r.position for r in failed.collect()] == [1, 3]
    shown = retrieval.source_rows(failed.withColumns({"id": F.lit("i"), "file_name": F.lit("f"), "score": F.lit(0.7)}))
    assert {r.score for r in shown.collect()} == {0.7}


@pytest.fixture(scope="module")
def library(spark):
    texts = [
        ("1_0", 0, "ABC_report.txt", "profit of the bank grew"), ("1_1", 0, "ABC_report.txt", "the weather was fine"),
        ("2_0", 0, "XYZ_report.txt", "profit of the bank grew fast"), ("3_0", 5, "other.txt", "bank profit"),
        ("4_0", 6, "hidden.txt", "profit of the bank grew"),
    ]
    df = spark.createDataFrame(texts, "id STRING, project_id BIGINT, file_name STRING, text STRING")
    return embed(df, HashedWords(64))


def ask(spark, queries, project=0, **extra):
    row = {"question_id": "q", "project_id": project, "queries": queries, **extra}
    types = {"prefixes": "ARRAY<STRING>", "rerank_query": "STRING"}
    schema = "question_id STRING, project_id BIGINT, queries ARRAY<STRING>" + "".join(f", {k} {types[k]}" for k in extra)
    return spark.createDataFrame([tuple(row.values())], schema)


def found(df):
    return [r.id for r in df.orderBy("source_no").collect()]


def test_retrieve_respects_scope(spark, library):
    assert set(found(retrieval.retrieve(ask(spark, ["bank profit"], 5), library, HashedWords(64)))) == {"1_0", "1_1", "2_0", "3_0"}
    assert set(found(retrieval.retrieve(ask(spark, ["bank profit"], -6), library, HashedWords(64)))) == set()
    assert found(retrieval.retrieve(ask(spark, ["  ", ""]), library, HashedWords(64))) == []


def test_dense_only_applies_the_score_floor(spark, library):
    one = retrieval.retrieve(ask(spark, ["bank profit"], 5), library, HashedWords(64), hybrid=False)
    assert set(found(one)) == {"1_0", "2_0", "3_0"}
    several = retrieval.retrieve(ask(spark, ["bank profit", "weather"], 5), library, HashedWords(64), hybrid=False)
    assert set(found(several)) == {"1_0", "1_1", "2_0", "3_0"}


def test_file_name_prefix_moves_a_chunk_up(spark, library):
    flat = lambda q, t: F.lit(None).cast("double")
    plain = ask(spark, ["profit of the bank grew fast"])
    boosted = ask(spark, ["profit of the bank grew fast"], prefixes=["abc", "bad prefix!"])
    for hybrid in (True, False):
        assert found(retrieval.retrieve(plain, library, HashedWords(64), hybrid=hybrid, scorer=flat))[0] == "2_0"
        assert found(retrieval.retrieve(boosted, library, HashedWords(64), hybrid=hybrid, scorer=flat))[0] == "1_0"


def test_rerank_query_overrides_the_first_query(spark, library):
    question = ask(spark, ["profit"], rerank_query="fine weather")
    assert found(retrieval.retrieve(question, library, HashedWords(64)))[0] == "1_1"


def test_embedder_must_return_one_vector_per_text(spark):
    class Short(HashedWords):
        def encode(self, texts):
            dense, sparse = super().encode(texts)
            return dense[1:], sparse

    df = spark.createDataFrame([("a",), ("b",)], "text STRING")
    with pytest.raises(Exception, match="2 texts but 1 dense"):
        embed(df.coalesce(1), Short(8)).collect()


def test_embed_is_unit_length_and_null_safe(spark):
    df = spark.createDataFrame([("A a b",), ("",), (None,)], "text STRING")
    got = embed(df, HashedWords(16)).collect()
    assert [round(sum(x * x for x in r.embedding), 5) for r in got] == [1.0, 0.0, 0.0]
    assert [r.sparse for r in got] == [{"a": 2.0, "b": 1.0}, {}, {}]


def test_upsert_replaces_whole_files(spark, rows):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "file_id INT, chunk_index INT, text STRING")
    new = spark.createDataFrame([(1, 0, "A"), (3, 0, "D")], "file_id INT, chunk_index INT, text STRING")
    assert rows(retrieval.upsert_chunks(old, new)) == [(1, 0, "A"), (2, 0, "c"), (3, 0, "D")]


def test_sparse_index_shuffles_no_postings_and_adds_up_equal_ids(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, {"x": 1.0}), ("a", 1, {"x": 1.0, "y": 3.0}), ("b", 1, {"x": 1.5})], "id STRING, project_id LONG, sparse MAP<STRING, FLOAT>")
    queries = spark.createDataFrame([("q", 0, 1, {"x": 2.0})], "question_id STRING, query_no LONG, project_id LONG, sparse MAP<STRING, FLOAT>")
    index = write_sparse_index(chunks, str(tmp_path / "sparse"))
    assert "postings" not in index.rows.columns
    assert [(r.id, r.score) for r in index.search(queries, 2).orderBy("rank").collect()] == [("a", 4.0), ("b", 3.0)]


def test_lists_of_chunks_are_found_in_bounded_parts(spark, tmp_path):
    points = RNG.normal(size=(60, 4))
    chunks = spark.createDataFrame([(str(i), 1, p.tolist()) for i, p in enumerate(points)], "id STRING, project_id LONG, embedding ARRAY<DOUBLE>")
    assert search_index._nearest(points, points[:7], 21).tolist() == search_index._nearest(points, points[:7]).tolist()
    assert write_dense_index(chunks, str(tmp_path / "dense"), 7).rows.count() == 60
