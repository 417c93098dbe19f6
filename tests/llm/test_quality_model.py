import numpy as np

from quarry.llm import quality_model as qm
from quarry.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    found = QUERIES["op3_quality_model"](spark, sf).toPandas()
    assert len(found) == 10000 and found.score.between(0, 1).all() and ((found.score >= 0.7) == (found.predicted == 1)).all()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.97
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() >= 0.99
    # Calibration: mean score and share of good texts agree.
    assert abs(held.score.mean() - held.quality.mean()) < 0.03


def test_context_sums_equal_brute_force():
    raws = [b"a b c, d", b"", b"e", b"a a a", b"x y " * 50]
    sums = qm.ContextSums()
    for raw in raws:
        sums.add(qm.token_rows(raw))
    sums.flush()
    want = np.zeros_like(sums.sums)
    for raw in raws:
        rows = qm.token_rows(raw)
        for i, r in enumerate(rows):
            for j in range(max(0, i - qm.REACH), min(len(rows), i + qm.REACH + 1)):
                if i != j:
                    want[r] += qm.index_vectors()[rows[j]]
    assert (sums.sums[: qm.BUCKETS] == want[: qm.BUCKETS]).all()


def test_blocks_change_nothing(monkeypatch):
    raw, vectors = b"some words, and marks! " * 500, np.random.default_rng(0).normal(size=(qm.BUCKETS, qm.DIMENSIONS)).astype(np.float32)
    whole = qm.pooled(raw, vectors)
    sums = qm.ContextSums()
    sums.add(qm.token_rows(raw))
    sums.flush()
    monkeypatch.setattr(qm, "BLOCK", 100)
    again = qm.ContextSums()
    again.add(qm.token_rows(raw))
    again.flush()
    assert np.allclose(qm.pooled(raw, vectors), whole, atol=1e-5) and (again.sums[: qm.BUCKETS] == sums.sums[: qm.BUCKETS]).all()


def test_odd_rows(spark, frame):
    docs = frame([(1, None), (2, ""), (2, "word"), (None, "x " * 200000)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    vectors = qm.word_vectors(docs)
    found = qm.score_quality(docs, qm.train(docs, labels, vectors)).toPandas()
    assert len(found) == 4 and found.score.between(0, 1).all() and list(found.columns) == ["doc_id", "score", "predicted"]


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    vectors = qm.word_vectors(docs)
    schema = "doc_id long, quality int"
    none = qm.train(docs, spark.createDataFrame([], schema), vectors)
    assert qm.score_quality(docs, none).toPandas().score.tolist() == [0.5, 0.5]
    good = qm.train(docs, spark.createDataFrame([(1, 1)], schema), vectors)
    assert qm.score_quality(docs, good).toPandas().score.round(3).tolist() == [0.667, 0.667]
    assert qm.score_quality(docs.limit(0), good).count() == 0
