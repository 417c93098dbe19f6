import math
import tracemalloc
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarry.llm import lm


def plain_tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def plain(rows):
    counts = Counter()
    for _, text, held in rows:
        if not held:
            counts.update(plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text, held in rows:
        tokens = plain_tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out.append((str(doc_id), held, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)))
    return sorted(out)


ROWS = [(k, f"The cat number{k % 5} sat on mat {k % 3} quietly", k % 4 == 0) for k in range(40)]
ROWS += [(100, None, False), (101, "", True), (101, " \t", True), (None, "É é THE\x0bcat", False), (102, "cat " * 20000, True), (103, "novel words", True)]
SCHEMA = "doc_id long, text string, held_out boolean"


@pytest.mark.parametrize("shard_bytes", [1, 300, 8 << 20])
def test_base_equals_brute_force(spark, shard_bytes):
    found = lm.score_texts(spark.createDataFrame(ROWS, SCHEMA), shard_bytes).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert got == plain(ROWS)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_probabilities_sum_to_one(spark):
    shards = lm.build_shards(spark.createDataFrame(ROWS, SCHEMA))
    counts = lm.word_counts(shards)
    model = replace(lm.train(shards, lm.new_model(shards, words=6)), distinct=counts.count())
    size = len(model.words)
    assert size == 6
    for last, before in ((0, 1), (size, size), (size + 1, size + 1)):
        p = 10 ** lm.log_probabilities(model, np.arange(size + 1), np.full(size + 1, last), np.full(size + 1, before))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    # The base score shares out all known words and one unseen.
    every = np.array([r["c"] for r in counts.collect()] + [0])
    assert (10 ** model.base(every)).sum() == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("shard_bytes", [400, 8 << 20])
def test_frequent_words_are_exact(spark, shard_bytes, monkeypatch):
    words = [(k, " ".join(f"w{int(j**1.5) % (k % 17 + 1)}" for j in range(60)), k % 5 == 0) for k in range(80)]
    shards = lm.build_shards(spark.createDataFrame(words, SCHEMA), shard_bytes)
    counts = Counter(t for _, text, held in words if not held for t in plain_tokens(text))
    for n in (4, 100):
        want = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:n]
        for often in (2, 50):
            assert lm.frequent_words(shards, n, often) == want
        monkeypatch.setattr(lm, "CANDIDATES", 1)
        assert lm.frequent_words(shards, n, 2) == want
        monkeypatch.undo()


def test_learns_contexts(spark):
    rows = [(k, "a b a b a b a b c d c d c d" if k % 2 else "c d c d a b a b", zlib.crc32(str(k).encode()) % 10 == 0) for k in range(400)]
    found = lm.score_texts(spark.createDataFrame(rows, SCHEMA).coalesce(1), rounds=60).filter("held_out").toPandas()
    assert found.score.sum() > 0.8 * found.base_score.sum()


def test_nothing_to_train_on(spark):
    rows = [(1, "a b", True), (2, None, True)]
    found = lm.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 and abs(r["score"]) < 1e-6 for r in found)
    assert lm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_text_scores_above_base(spark):
    from quarry.llm.queries import QUERIES

    found = QUERIES["op7_lm_score"](spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert len(found) > 50 and found.score.sum() > found.base_score.sum()


def test_every_training_word_has_rows_of_its_own(spark):
    """With two frequent words besides the end mark, all x and y are "another word"; x stand beside a, y beside b."""
    rows = [(k, " ".join(f"{'ab'[k % 2]} {'xy'[k % 2]}{(k // 2 * 3 + i) % 20}" for i in range(6)), False) for k in range(200)]
    asked = [(1000, "a x1", True), (1001, "a y1", True), (1002, "x3 x4", True), (1003, "x3 y4", True)]
    found = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows + asked, SCHEMA).coalesce(1), words=3, rounds=20).collect()}
    # Equal counts, so only the words' own target and context rows tell these apart.
    for likely, unlikely in ((1000, 1001), (1002, 1003)):
        assert found[likely]["base_score"] == pytest.approx(found[unlikely]["base_score"])
        assert found[likely]["score"] > found[unlikely]["score"] + 0.1


def test_shares_of_other_words_sum_to_one(spark):
    shards = lm.build_shards(spark.createDataFrame(ROWS, SCHEMA))
    model = lm.train(shards, lm.new_model(shards, words=4))
    table = lm.word_rows(shards, model)
    share = lm.sharing(table, model)
    assert table.count() == lm.word_counts(shards).count()
    rows = [r for r in table.collect() if bytes(r["word"]) not in model.words]
    k, shares = len(model.words), share.shares
    counts = np.array([r["c"] for r in rows] + [0])
    unseen = [[0] * lm.COMPONENTS]
    codes = lm.codes_of(np.array([r["t"] for r in rows] + unseen), shares, lm.TARGET_LEVELS)
    after = k + 1 + lm.codes_of(np.array([r["n"] for r in rows] + unseen), shares, lm.CONTEXT_LEVELS)
    assert codes[-1] == 0 and after[-1] == k + 1 and codes.max() < 1 << lm.TARGET_BITS and after.max() - k - 1 < 1 << lm.CONTEXT_BITS
    # Any two of: a frequent word, the start, a code, an unseen word.
    for last, before in ((0, k), (after[0], 1), (after[-1], after[1]), (k, k)):
        one = np.array([last]), np.array([before])
        p = 10 ** share.log_shares(counts, codes, np.arange(len(counts)), *one, np.zeros(len(counts), int))
        assert p.sum() == pytest.approx(1, abs=1e-6)
        p = 10 ** lm.row_probabilities(model, np.arange(k + 1), *one, np.zeros(k + 1, int), share.rows)
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_packed_words_keep_count_and_codes(spark):
    shards = lm.build_shards(spark.createDataFrame(ROWS, SCHEMA))
    model = lm.train(shards, lm.new_model(shards, words=4))
    table = lm.word_rows(shards, model)
    share = lm.sharing(table, model)
    packed = {bytes(r["word"]): r["packed"] for r in lm.packed_words(table, share.shares).collect()}
    for r in table.collect():
        code = lm.codes_of(np.array([r["t"]]), share.shares, lm.TARGET_LEVELS)[0]
        after = lm.codes_of(np.array([r["n"]]), share.shares, lm.CONTEXT_LEVELS)[0]
        assert packed[bytes(r["word"])] == (r["c"] << 26) + (int(code) << 13) + int(after)


def test_names_of_looks_up_without_python_words():
    words = pa.array([b"b", b"", b"zz", b"a", b"b"], pa.binary())
    assert lm.names_of(words, pa.array([b"a", b"b"], pa.binary())).tolist() == [1, 2, 2, 0, 1]
    assert lm.names_of(words.cast(pa.large_binary()), pa.array([], pa.binary())).tolist() == [0] * 5
    assert lm.names_of(words, pa.array([], pa.binary())).dtype == np.int32


def test_shard_columns_take_each_shard_of_a_batch_alone():
    shards = []
    for number, texts in ((4, [(1, False, b"a b"), (2, True, b"c")]), (5, [(3, False, None)])):
        shard = lm.Shard(number)
        for text in texts:
            shard.add(*text)
        shards.append(shard.row())
    batch = pa.Table.from_batches(shards).combine_chunks().to_batches()[0]
    first, second = lm.shard_columns([batch])
    assert (first["shard"].as_py(), second["shard"].as_py()) == (4, 5)
    assert first["words"].to_pylist() == [b"a", b"b", b"", b"c"] and second["words"].to_pylist() == [b""]
    lengths, training = lm.places_of(first)
    assert (lengths.tolist(), training.tolist()) == ([3, 2], [True, True, True, False, False])
    lengths, training = lm.places_of(second)
    assert (lengths.tolist(), training.tolist()) == ([1], [True])


@pytest.mark.parametrize("window, components", [(0, 3), (1, 8), (4, 8), (3, 19), (40, 9), (70, 2)])
def test_components_of_counts_the_votes_around(window, components):
    rng = np.random.default_rng(window)
    votes = np.append(np.arange(30) % components, [-1, -1])
    lengths = np.array([1, 2, 1, 90, 3])
    target = rng.integers(0, 32, lengths.sum())
    expected, start = [], 0
    for length in lengths:
        own = votes[target[start : start + length]]
        for i in range(length):
            near = [v for j, v in enumerate(own) if 0 < abs(i - j) <= window and v >= 0]
            expected.append(max(range(components), key=lambda k: (near.count(k), -k)) if near else -1)
        start += length
    assert lm.components_of(votes, target, lengths, window, components).tolist() == expected


def test_row_sums_with_more_rows_than_two_bytes_hold():
    rows = np.array([40_000, 2, 40_000, 0], np.int64)
    values = np.arange(8, dtype=np.float32).reshape(4, 2)
    for n, shift in ((40_001, 0), (1 << 15, 40_000 - 32_767)):
        own = np.where(rows == 40_000, rows - shift, rows)
        out = lm.row_sums(own, values, n)
        assert out[own[0]].tolist() == [4, 6] and out[2].tolist() == [2, 3] and out[0].tolist() == [6, 7] and out.sum() == values.sum()


def test_every_shard_is_a_row_group(spark):
    """Readers hold a row group at once, so several shards of megabytes in one are several times the memory."""
    shards = lm.build_shards(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), 300)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in shards.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert len(groups) > 5 and set(groups) == {1} and len(groups) == shards.count()


def test_text_blocks_are_whole_texts():
    lengths = np.array([3, 1, 7, 2, 2, 1])
    assert list(lm.text_blocks(lengths, 4)) == [(slice(0, 2), slice(0, 4)), (slice(2, 3), slice(4, 11)), (slice(3, 5), slice(11, 15)), (slice(5, 6), slice(15, 16))]
    assert list(lm.text_blocks(lengths, 100)) == [(slice(0, 6), slice(0, 16))] and not list(lm.text_blocks(lengths[:0], 4))


def a_shard(texts, seed=11):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 600, texts)
    local = rng.integers(0, 500, lengths.sum()).astype(np.int32)
    return np.where(np.arange(500) < 100, np.arange(500), 100), local, lengths, rng.random(len(local)) < 0.9, np.append(rng.integers(0, 8, 100), [-1, -1])


def test_place_counts_by_blocks_of_texts(monkeypatch):
    found = lm.place_counts(*a_shard(40))
    for places in (1, 700, 5000):
        monkeypatch.setattr(lm, "VOTES_AT_ONCE", places)
        for one, whole in zip(lm.place_counts(*a_shard(40)), found):
            assert one.dtype == np.int32 and one.shape == (500, 8) and (one == whole).all()
    names, local, lengths, training, votes = a_shard(40)
    component = lm.components_of(votes, names[local], lengths)
    assert found[0].sum() == (training & (component >= 0)).sum()


def test_place_counts_hold_a_part_of_the_places():
    shard = a_shard(4000)
    assert len(shard[1]) > 1 << 20
    tracemalloc.start()
    lm.place_counts(*shard)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36 * len(shard[1])


def test_scores_by_blocks_of_contexts(monkeypatch):
    rng = np.random.default_rng(13)
    small = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    model = lm.Model({bytes([k]): k for k in range(9)}, 100, 20, np.arange(9), 0.5, small(10), small(11, 4), small(4, 4), small(4, 4), small(10, 4), small(10))
    share = lm.Sharing(np.full(8, 1 / 8), rng.random(8) + 1, rng.random((5, 8)), small(30, 4), small(30, 8))
    a, b, at = rng.integers(0, 30, 50), rng.integers(0, 30, 50), rng.integers(0, 50, 400)
    ask = lambda: (lm.row_probabilities(model, at % 10, a, b, at, share.rows), share.log_shares(np.arange(7), np.arange(7) % 5, at % 7, a, b, at))
    whole = ask()
    monkeypatch.setattr(lm, "PLACES_AT_ONCE", 7)
    assert all((one == other).all() for one, other in zip(ask(), whole))
