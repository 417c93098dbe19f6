import pandas as pd

from quarry.llm import langid

ODD = [(900001, None), (900002, ""), (900003, "123 !!"), (900004, "é" * 300000), (900005, "the " * 200000)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from quarry.llm.queries import QUERIES

    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_odd_texts(spark, frame):
    train = spark.createDataFrame([(k, "the cat and the dog" if k % 2 else "le chat et la souris", "en" if k % 2 else "fr") for k in range(200)], "doc_id long, text string, lang string")
    model = langid.train(train)
    docs = frame([*ODD, (1, "the dog and cat"), (1, "the dog and cat"), (None, "la souris et le chat")])
    got = langid.identify(docs, model).toPandas()
    assert len(got) == 8 and set(docs.columns) <= set(got.columns)
    by = {i: (p, r) for i, p, r in zip(got.doc_id.fillna(-1).astype(int), got.lang_pred, got.rejected)}
    assert by[900001] == by[900002] == by[900003] == ("und", True)
    assert by[1] == ("en", False) and by[-1] == ("fr", False) and by[900005][0] == "en"
    kept = langid.filter_language(docs, model)
    assert kept.columns == docs.columns and {900001, 900002, 900003}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    got = langid.identify(none, langid.train(none)).toPandas()
    assert got.lang_pred.tolist() == ["und"] and got.score.tolist() == [0.0]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert isinstance(langid.identify(empty, langid.train(empty)).toPandas(), pd.DataFrame)


def test_long_texts_are_hashed_whole():
    text = b"abc def " * 100000
    whole = langid.subword_counts(text)
    old, langid.BLOCK = langid.BLOCK, 1000
    try:
        assert (langid.subword_counts(text) == whole).all()
    finally:
        langid.BLOCK = old
