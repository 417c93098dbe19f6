import random

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.components import connected_components


def plain_fingerprint(text, k=3):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, bits=2):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[root(i)] for i in range(len(ids))]


TEXTS = [None, "", " \t\n", "a", "A", "a b", "a b c", "A  B\nC", "É é x y", "x" * 5000, "the cat sat on the mat " * 400, "one two three four\x0bfive"]


def test_fingerprints_are_exact():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for text in texts:
        raw = None if text is None else text.encode()
        assert simhash.fingerprint(raw) == plain_fingerprint(text)


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr("quarry.llm.common.LONG_BYTES", -1)
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 8, 9, 10, 50):
        text = " ".join(rng.choice("abcdefgh") for _ in range(n))
        for k in (1, 2, 3):
            assert simhash.fingerprint(text.encode(), k) == plain_fingerprint(text, k)


def near_fingerprints(rng, n):
    out = []
    for centre in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(n // 4):
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                centre_ = centre ^ 1 << bit
                out.append(centre_)
                centre = centre_ if rng.random() < 0.1 else centre
    return out


@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_components_equal_brute_force(spark, cell_rows):
    fps = near_fingerprints(random.Random(5), 200)
    fps += fps[:20]
    ids = [*range(1, len(fps)), None]
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    found = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    owners = found.select("fp").distinct()
    sizes = simhash.cells(owners, cell_rows=cell_rows).groupBy("mask", "value").count()
    assert sizes.agg({"count": "max"}).first()[0] <= cell_rows
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.components(found, cell_rows=cell_rows).collect()}
    assert got == {(i, f): c for i, f, c in zip(ids, signed, plain_components(ids, fps))}


def test_documents(spark, frame):
    rng = random.Random(2)
    base = [rng.choice("abcdefghijkl") * 3 for _ in range(300)]
    texts = [*TEXTS, " ".join(base), " ".join(base), " ".join(base[:-1]), " ".join(base) + " zzz"]
    rows = [(k if k != 6 else None, t) for k, t in enumerate(texts)] + [(3, "a")]
    fps = [plain_fingerprint(t) for _, t in rows]
    found = simhash.near_duplicates(frame(rows)).collect()
    want = sorted(str((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps)))
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in found) == want
    docs = frame(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # One row of each group, that with its smallest id.
    groups = {}
    for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps)):
        groups.setdefault(c if c is not None else f"fp{f}", c)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, groups.values()))


def test_rows_without_ids_keep_one(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "A b  c"), (None, "x y z"), (3, "q"), (3, "q"), (3, "Q")], "doc_id long, text string")
    kept = sorted(str(tuple(r)) for r in simhash.keep_one(docs).collect())
    assert len(kept) == 3 and sum("(3, " in k for k in kept) == 1 and "(None, 'x y z')" in kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_connected_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [1, 50, 101]
