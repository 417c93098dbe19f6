import hashlib
import random
import re

import pytest

from quarry.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "item_id long, text string"


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, n=10):
    windows = []
    for item_id, text in items:
        words = plain_words(text)
        windows += [(item_id, words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    out = []
    for doc_id, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for item_id, w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    ids.add(item_id)
        ids.discard(None)
        names = ",".join(sorted(map(str, ids)))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def got(docs, items, **options):
    rows = dc.contamination(docs, items, **options).drop("text_hash").collect()
    return sorted(str(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))) for r in rows)


def cases():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("a b c d e f É9 ж z1".split()) for _ in range(n))
    passage = say(30)
    items = [(1, passage), (2, passage.upper()), (3, "a-b c"), (10, say(12)), (4, None), (5, "!!"), (None, "zz zz"), (1, passage), (6, "the " * 10)]
    docs = [(k, say(rng.randint(0, 60))) for k in range(30)]
    docs += [(100, f"x {passage}, y {passage}"), (100, passage), (101, None), (102, ""), (103, "..."), (None, "Zz! zz"), (104, "the " * 5000)]
    docs += [(105, " ".join(passage.split()[:9])), (106, " ".join(passage.split()[:10])), (107, "a b"), (108, "c d")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1, 500, 8 << 20])
def test_equals_brute_force(spark, frame, shard_bytes):
    docs, items = cases()
    assert got(frame(docs), spark.createDataFrame(items, SCHEMA), shard_bytes=shard_bytes) == plain(docs, items)


def test_test_texts_in_blocks(spark, frame, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(dc.blocks, "__defaults__", (64,))
    assert len(list(dc.blocks(spark.createDataFrame(items, SCHEMA)))) > 3
    assert got(frame(docs), spark.createDataFrame(items, SCHEMA)) == plain(docs, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two three"), (2, "one two"), (3, "three"), (4, "one y y y two three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], SCHEMA)
    found = {r["doc_id"]: r["contaminated"] for r in dc.contamination(docs, items, slop=1, shard_bytes=1 << 20).collect()}
    assert found == {1: True, 2: False, 3: False, 4: False}
    assert not any(r["contaminated"] for r in dc.contamination(docs, items).collect())


def test_clean_documents_stay(spark, frame):
    docs, items = cases()
    table, items_ = frame(docs), spark.createDataFrame(items, SCHEMA)
    kept = dc.drop_contaminated(table, items_)
    dirty = {line.split(",")[0][1:] for line in plain(docs, items) if line.endswith("True)")}
    assert kept.columns == table.columns
    want = [i for i, t in docs if plain([(i, t)], items)[0].endswith("False)")]
    assert dirty and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], SCHEMA)
    assert got(docs, none) == plain([(1, "a b")], [])
    assert dc.contamination(docs.limit(0), none).count() == 0
