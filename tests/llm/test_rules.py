from quarry.llm import rules

LONG = " ".join(f"word{k} and{k % 7} some" for k in range(60))


def plain_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return len(inside)


def test_counts():
    f = rules.Facts("É b#\n\n a  a\x0bb\na a\n#".encode())
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines) == (8, 9, 2, 0)
    assert rules.Facts(b"x\n x\nx\n\n\nx").n_dup_lines == 2
    for text in ("a b c a b c", "a a a a", "a b", "", "a b c d a b c e f a b c", "x y z y z x y z"):
        assert rules.Facts(text.encode()).n_repeat_words == plain_repeats(text.split())


def test_clean_text_stays_and_junk_goes():
    keep = lambda t: rules.passes(rules.Facts(t.encode()), rules.RULES)
    assert keep(LONG)
    assert not keep("few words")
    assert not keep(" ".join(w + "###" for w in LONG.split()))
    assert not keep(LONG.upper())
    assert not keep("same line again\n" * 40)
    assert not keep(" | ".join(f"cell{k}" for k in range(99)))


def test_order_changes_price_not_verdict(spark, frame):
    rows = [(k, t) for k, t in enumerate([None, "", LONG, LONG, LONG.upper(), "a " * 99, "x" * 100000])]
    docs = frame(rows)
    order = rules.plan_order(docs)
    assert set(order) == set(rules.RULES)
    seen = []
    spy = tuple(rules.Rule(r.name, lambda f, r=r: seen.append(r.name) or r.fails(f)) for r in order)
    assert not rules.passes(rules.Facts(b"few"), spy)
    assert len(seen) <= len(order) and seen == [r.name for r in order][: len(seen)]
    kept = rules.filter_quality(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    facts = {r["doc_id"]: r for r in rules.quality_facts(docs).collect()}
    assert [facts[k]["kept"] for k in range(7)] == [False, False, True, True, False, False, False]
    assert facts[0]["n_words"] == 0 and facts[0]["base_failed"]


def test_best_ratio_first(spark):
    docs = spark.createDataFrame([(k, "x") for k in range(20)], "doc_id long, text string")
    slow = rules.Rule("slow", lambda f: sum(range(200000)) >= 0)
    quick, never = rules.Rule("quick", lambda f: True), rules.Rule("never", lambda f: False)
    assert [r.name for r in rules.plan_order(docs, (never, slow, quick))] == ["quick", "slow", "never"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rules.quality_facts(docs).count() == 0 and rules.filter_quality(docs).count() == 0


def test_long_texts_count_the_same(monkeypatch):
    texts = ["a b c a b c\na b\n\n a b\na b", "x y z y z x y z", "", " \n\t", "é b# c\nd", "a a a a\n" * 30, LONG]
    whole = [[getattr(rules.Facts(t.encode()), n) for n in ("n_words", "n_lines", "n_dup_lines", "n_repeat_words")] for t in texts]
    monkeypatch.setattr(rules, "LONG_BYTES", -1)
    monkeypatch.setattr("quarry.llm.common.LONG_BYTES", -1)
    assert [[getattr(rules.Facts(t.encode()), n) for n in ("n_words", "n_lines", "n_dup_lines", "n_repeat_words")] for t in texts] == whole
