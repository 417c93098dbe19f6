"""Token counts against the libraries themselves, and what the cache is asked for."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import token_counts
from quarry.llm.token_counts import WordCounts, count_tokens, folded_ascii, load_tokenizer, parts_of, text_counter, words_of

TEXTS = [
    None, "", " ", "\n", "plain words here", "two  blanks   three", " leading and trailing ", "tab\tand\nline \n and", "<|endoftext|>",
    "a<|endoftext|>b <|endoftext|> c", "no break  em  line", "\x1c odd \x1f controls", "Ünïcode straße ✓ 漢字 かな 🎉🎉", "it's we'll I'd '' 's",
    "1234 5678.9", "x" * 3000, ("long text with words, " * 4000), "word " * 5, "word ", "́ combining é",
]


def library_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in texts]
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.fixture
def cache(tmp_path):
    return str(tmp_path / "cache")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_the_library(frame, cache, name):
    docs = frame(list(enumerate(TEXTS)))
    found = count_tokens(docs, load_tokenizer(public_tokenizers.path(name)), cache, limit=1024)
    rows = {r["doc_id"]: r for r in found.collect()}
    for i, (text, n) in enumerate(zip(TEXTS, library_counts(name, TEXTS))):
        assert rows[i]["n_tokens"] == n, text
        assert rows[i]["n_bytes"] == len((text or "").encode())
        assert rows[i]["over_limit"] == (n > 1024)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_long_texts_in_parts_count_as_the_whole():
    tokenizer = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    count = tokenizer.counter()
    for text in (t for t in TEXTS if t):
        parts = list(parts_of(text, size=7))
        assert "".join(parts) == text
        assert sum(count(parts)) == count([text])[0], text
        assert "".join(words_of(text)) == text
        assert text_counter(tokenizer)(text) == count([text])[0], text


def test_words_are_forgotten_by_generation_without_other_counts():
    asked = []
    words = WordCounts(lambda new: [asked.append(w) or len(w) for w in new], most=3)
    texts = [["a", "bb", "a"], ["ccc", "dddd"], ["a", "eeeee"], ["bb"], ["z" * 100], ["z" * 100]]
    assert [words(t) for t in texts] == [sum(map(len, t)) for t in texts]
    assert asked.count("a") == 1 and asked.count("z" * 100) == 2


def test_only_distinct_misses_are_encoded_and_appended(spark, frame, cache):
    tokenizer = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    count_tokens(frame([(1, "one text"), (2, "one text"), (3, "other"), (3, "other"), (None, "nobody's"), (None, "nobody's")]), tokenizer, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 3 == stored.select("content").distinct().count()
    assert {r["tokenizer"] for r in stored.collect()} == {tokenizer.version}
    count_tokens(frame([(9, "other"), (10, "new"), (11, None)]), tokenizer, cache).collect()
    assert spark.read.parquet(cache).count() == 5


def test_stored_counts_are_used_for_their_tokenizer_only(spark, frame, cache, rows):
    tokenizer = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    marked = spark.createDataFrame([("one text",)], "t string").select(
        F.unhex(F.sha2("t", 256)).alias("content"), F.lit(8).cast("long").alias("n_bytes"), F.lit(77).cast("long").alias("n_tokens"), F.lit(tokenizer.version).alias("tokenizer")
    )
    for _ in range(2):  # an append that was done twice
        marked.write.mode("append").partitionBy("tokenizer").parquet(cache)
    docs = frame([(1, "one text"), (2, "one text"), (3, "two")])
    assert rows(count_tokens(docs, tokenizer, cache)) == [(1, 8, 77), (2, 8, 77), (3, 3, 1)]
    other = load_tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    assert {r[2] for r in rows(count_tokens(docs.filter("doc_id < 3"), other, cache))} == set(library_counts("piece_bpe_32k.model", ["one text"]))


def test_folding_is_unseen_by_a_lower_casing_tokenizer(spark, frame, cache):
    texts = ["One  TEXT\n here", "one text here", "ÉCOLE é É", "A  \t B", " x "]
    tokenizer = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    found = {r["doc_id"]: r["n_tokens"] for r in count_tokens(frame(list(enumerate(texts))), tokenizer, cache, normalise=folded_ascii).collect()}
    assert [found[i] for i in range(len(texts))] == library_counts("word_bpe_49k.json", texts)
    assert spark.read.parquet(cache).count() == len(texts) - 1


def test_many_misses_are_joined_without_broadcast(frame, cache, rows, monkeypatch):
    monkeypatch.setattr(token_counts, "small", lambda df: df)
    tokenizer = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame([(i, f"text {i % 7}") for i in range(200)] + [(None, "x")])
    assert {r[2] for r in rows(count_tokens(docs.filter("doc_id IS NOT NULL"), tokenizer, cache))} == {2}


def test_an_empty_table_has_no_rows(frame, cache):
    tokenizer = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert count_tokens(frame([]), tokenizer, cache, limit=5).count() == 0
