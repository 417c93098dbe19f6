"""Edge cases that several operators share: clashing names, empty tables, very long rows, an unlearned language."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, lm, preference, simhash, warc

CLASHES = ("__id", "__hash", "key_id", "key_hash", "w", "kept", "rank", "count", "group", "text_hash")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten eleven twelve "


@pytest.fixture
def docs(spark):
    rows = [(1, LONG * 3), (1, LONG * 3), (2, LONG * 3), (3, "other words entirely " * 9), (None, "no id " * 30), (4, "w " * 400_000), (5, None), (6, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASHES})


def test_filters_keep_columns_of_any_name(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "4", "5", "6", "None"]


def test_filters_on_empty_tables(spark, docs):
    none, items = docs.limit(0), spark.createDataFrame([(1, LONG)], "item_id long, text string")
    train = spark.createDataFrame([(1, "a word", "en")], "doc_id long, text string, lang string")
    assert langid.filter_language(none, langid.train(train)).count() == 0
    assert decontaminate.drop_contaminated(none, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_whole_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and found.columns[0] == "doc_id"


def test_a_language_that_was_not_learned_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert model.threshold > 0.5
    strange = ["これは日本語で書かれた長い文章です。" * 8, "Это длинный текст на русском языке. " * 8, "זהו טקסט ארוך בעברית " * 8]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(strange)], "doc_id long, text string")
    assert langid.filter_language(asked, model).count() == 0
    clean = docs.filter("lang IS NOT NULL AND length(text) > 200")
    assert langid.filter_language(clean, model).count() >= 0.985 * clean.count()


def test_archives_of_clashing_columns_and_very_long_payloads(spark):
    rows = [(1, "http://a/", "x" * 3_000_000), (2, "http://b/", "x" * 3_000_000), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("id", "payload", "archive", "offset")})
    read = warc.read_records(warc.write_archives(warc.page_records(pages)))
    got = {int(r["record_id"]): (r["record_type"], r["payload_bytes"]) for r in read.collect()}
    assert got == {1: ("revisit", 3_000_000), 2: ("response", 3_000_000), 3: ("response", 0)}


def test_preference_pairs_of_clashing_columns_and_very_long_texts(spark):
    turns = [(1, 0, "user", "q" * 500_000), (1, 1, "assistant", "yes")], [(1, 0, "user", "q" * 500_000), (1, 1, "assistant", "no")]
    sides = [spark.createDataFrame(t, "pair_id long, turn long, role string, text string").withColumns({c: F.lit(7) for c in ("side", "copy", "part", "digest")}) for t in turns]
    found = preference.segments(*sides).collect()
    assert sorted((r["part"], len(r["body"]) > 400_000) for r in found) == [("chosen", False), ("prompt", True), ("rejected", False)]


def test_scores_of_clashing_columns(spark, docs):
    asked = docs.withColumn("held_out", F.lit(False)).withColumns({c: F.lit(7) for c in ("shard", "words", "tokens", "lengths", "word")})
    assert lm.score_texts(asked).count() == docs.count()
