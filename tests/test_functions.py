import datetime as dt
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import arrays, dates, text
from quarry.functions.records import distinct_matches, normalize_rewrites, plan_tasks
from quarry.operators import cleaning, conversation, entities, evaluation, statements, tokens
from quarry.operators.cleaning import Field


def one(spark, column, schema="x INT", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_clean_names():
    assert cleaning.clean_name(" a b-c.d ") == "a_b_c_d"
    assert cleaning.header_name(" Ownership (%) ") == "ownership_pct"


def test_shape_keeps_first_duplicate_and_adds_missing(spark):
    df = spark.createDataFrame([("1", "2", "x", "1,234.5", "31/12/2024")], "a STRING, b STRING, c STRING, d STRING, e STRING")
    df = df.toDF("Code", "CODE", "Unknown", "Ownership (%)", "day")
    schema = {
        "id": Field("string", nullable=False),
        "sub": Field("string"),
        "own": Field("double"),
        "day": Field("date"),
        "kind": Field("string", nullable=False, fallback="UNKNOWN"),
        "note": Field("string", nullable=False),
    }
    got = cleaning.shape_to_schema(df, schema, {"code": "sub", "ownership_pct": "own"}).first()
    assert (got.sub, got.own, got.day, got.kind, got.note) == ("1", 1234.5, dt.date(2024, 12, 31), "UNKNOWN", "")
    assert len(got.id) == 36


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2024-05-07", dt.date(2024, 5, 7)),
        ("07/05/2024", dt.date(2024, 5, 7)),
        ("07-05-2024", dt.date(2024, 5, 7)),
        ("05/17/2024", dt.date(2024, 5, 17)),
        ("17.05.2024", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, raw, want):
    assert one(spark, cleaning.first_date(F.col("x")), "x STRING", (raw,)) == want


@pytest.mark.parametrize("raw, kind, want", [("1,234", "int", 1234), ("1,2.5", "double", 12.5), ("1.5", "long", None), ("n/a", "double", None), ("9999999999", "int", None)])
def test_numbers(spark, raw, kind, want):
    assert one(spark, cleaning.number(F.col("x"), kind), "x STRING", (raw,)) == want


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('text ```JSON {"a": [1, 2]} ``` more', {"a": [1, 2]}),
        ('```\nnot json\n```\n```{"a": 2}```', {"a": 2}),
        ('Sure: {"a": {"b": 1}} ok', {"a": {"b": 1}}),
        ("{broken", None),
        ("", None),
        (None, None),
        ("no braces", None),
    ],
)
def test_loose_json(spark, reply, want):
    got = one(spark, text.loose_json(F.col("x")), "x STRING", (reply,))
    assert (json.loads(got) if got is not None else None) == want


def test_entities_and_prefixes(spark):
    raw = [" ACB ", "acb", "a" * 101, "bad<tag>", "Hòa Phát", "", None] + [f"m{i}" for i in range(20)]
    got = one(spark, text.clean_entities(F.col("x")), "x ARRAY<STRING>", (raw,))
    assert got == ["ACB", "a" * 101, "Hòa Phát"] + [f"m{i}" for i in range(20)]
    few = one(spark, text.clean_entities(F.col("x"), 100, 10), "x ARRAY<STRING>", (raw,))
    assert few == ["ACB", "Hòa Phát"] + [f"m{i}" for i in range(8)]
    assert one(spark, text.normalize_prefixes(F.col("x")), "x ARRAY<STRING>", ([" vnm ", "VNM_", "a b", "x__", "hpg_"],)) == ["VNM_", "HPG_"]


@pytest.mark.parametrize(
    "raw, id_, rest",
    [("[b-001] hi", "B-001", "hi"), (" [ G-20 ]\nline\nmore ", "G-20", "line\nmore"), ("no [B-1] token", None, "no [B-1] token"), (None, None, "")],
)
def test_test_token(spark, raw, id_, rest):
    assert one(spark, text.test_id(F.col("x")), "x STRING", (raw,)) == id_
    assert one(spark, text.test_text(F.col("x")), "x STRING", (raw,)) == rest


def test_paths_and_names(spark):
    path = lambda p, s: text.object_path(F.lit(p), F.lit(7), F.lit(s), F.lit("h"), F.lit("a/b\\c"))
    assert one(spark, path(-1, None)) == "incognito/no_session/h_a_b_c"
    assert one(spark, path(-1, "s1")) == "incognito/s1/h_a_b_c"
    assert one(spark, path(0, None)) == "base/user_7/h_a_b_c"
    assert one(spark, path(3, None)) == "user_7/project_3/h_a_b_c"
    assert [one(spark, text.file_extension(F.lit(n))) for n in ("A.TXT", "a.tar.gz", "none", "x.")] == ["txt", "gz", "", ""]
    assert one(spark, text.url_host(F.lit("https://a.b:80/c/d"))) == "a.b:80"
    assert one(spark, text.url_host(F.lit("a.b/c"))) == ""


def test_fiscal_context_by_month(spark):
    def want(day):
        quarter = (day.month + 2) // 3
        last = (4, day.year - 1) if quarter == 1 else (quarter - 1, day.year)
        return (day.year, quarter, *last, day.year - (1 if day.month >= 4 else 2))

    days = [dt.date(2024, m, d) for m in range(1, 13) for d in (1, 28)] + [dt.date(2023, 3, 31), dt.date(2023, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d DATE")
    got = df.select("d", *[c.alias(n) for n, c in dates.fiscal_context(F.col("d")).items()]).collect()
    assert [tuple(r)[1:] for r in got] == [want(r.d) for r in got]


def test_jaccard_edges(spark):
    score = lambda a, b: one(spark, arrays.jaccard(F.col("a"), F.col("b")), "a ARRAY<STRING>, b ARRAY<STRING>", (a, b))
    assert score([], [" "]) == 1.0
    assert score(["x"], []) == 0.0
    assert score([" X", "y"], ["x", "z"]) == pytest.approx(1 / 3)


def test_sparse_clean_edges(spark):
    clean = lambda m: one(spark, arrays.clean_sparse(F.col("x")), "x MAP<STRING, STRING>", (m,))
    assert clean({"5": "0.5", "x": "1", "7": "heavy"}) == {5: 0.5}
    twice = F.create_map(F.lit("1"), F.lit("0.1"), F.lit("01"), F.lit("0.2"))
    assert one(spark, arrays.clean_sparse(twice)) == {1: 0.2}
    assert clean({}) == {0: 1e-9}


def test_query_list_edges(spark):
    schema = "o STRING, r STRING, p ARRAY<STRING>, c BOOLEAN"
    ask = lambda *row: one(spark, arrays.query_list(*[F.col(c) for c in "orpc"]), schema, row)
    assert ask("orig", "re", ["a", " a ", "", "re", "b", "c", "d"], False) == ["re", "a", "b", "c", "d"]
    assert ask("orig", "re", ["a"], True) == ["orig"]
    assert ask("orig", "", None, False) == ["orig"]
    assert ask("", "", ["a"], False) == []
    assert ask(None, None, ["a"], False) == []


def test_verdict_edges(spark):
    schema = "d STRING, raw ARRAY<STRING>, n INT"
    useful = arrays.useful_positions(F.col("raw"), F.col("n"))
    ask = lambda *row: (one(spark, useful, schema, row), one(spark, arrays.verdict(F.col("d"), useful, F.col("n")), schema, row))
    assert ask("sufficient", ["2", "2", "x", "9", "1"], 3) == ([2, 1], "sufficient")
    assert ask("sufficient", ["7"], 3) == ([], "partial")
    assert ask("great", ["1"], 3) == ([1], "partial")
    assert ask(None, [], 0) == ([], "insufficient")


def test_rewrite_defaults(spark):
    schema = (
        "user_text STRING, rewritten STRING, needs_clarification BOOLEAN, clarification STRING, scope_type STRING,"
        " preserved_entities ARRAY<STRING>, hypothetical_passages ARRAY<STRING>, clarification_suggestions ARRAY<STRING>"
    )
    data = [
        ("u", " ", False, "", "Nope", ["", " X "], [" p " * 900, "", "b", "c", "d"], ["s"]),
        ("u", "r" * 3000, True, None, " SECTOR", None, ["p"], [" s ", ""]),
        ("u", None, None, None, None, None, None, None),
    ]
    got = normalize_rewrites(spark.createDataFrame(data, schema)).collect()
    assert (got[0].rewritten, got[0].scope_type, got[0].preserved_entities) == ("u", "company", ["X"])
    assert [len(p) for p in got[0].hypothetical_passages] == [2698, 1, 1, 1] and got[0].clarification_suggestions == []
    assert (len(got[1].rewritten), got[1].scope_type, got[1].hypothetical_passages) == (3000, "sector", [])
    assert got[1].clarification.startswith("Bạn") and got[1].clarification_suggestions == ["s"]
    assert (got[2].rewritten, got[2].scope_type, got[2].needs_clarification) == ("u", "general", False)


def test_plan_and_matches(spark, rows):
    schema = "t ARRAY<STRUCT<tool_type: STRING, goal: STRING>>, e ARRAY<STRING>"
    tasks = [("Database", "a"), ("magic", "b"), ("visualize", "c"), (None, "d")]
    kept = one(spark, plan_tasks(F.col("t"), F.col("e")), schema, (tasks, ["database_query"]))
    assert [t.goal for t in kept] == ["a"]
    matches = spark.createDataFrame([(1, 0, "A"), (1, 1, "A"), (1, 2, ""), (2, 0, "A")], "record_id INT, pos INT, symbol STRING")
    assert rows(distinct_matches(matches)) == [(1, 0, "A"), (2, 0, "A")]


def test_ratios(spark):
    assert one(spark, statements.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, statements.ratio(F.lit(1), F.lit(3), 100)) == 33.33


def test_pie_drops_non_positive(spark, rows):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0), ("c", 0.0), ("d", -5.0), ("e", None)], "l STRING, v DOUBLE")
    assert rows(statements.pie_shares(df, "l", "v")) == [("(null)", 3.0, 75.0), ("a", 1.0, 25.0)]


def test_entities_resolve_and_leave_open(spark):
    master = [("ACB", "Asia Bank"), ("VNM", "Vina Milk"), ("X1", None), ("B%", "100% Fun")] + [(f"S{i:02d}", f"Steel {i}") for i in range(30)]
    mentions = [(1, "acb"), (1, "milk"), (1, "The Asia Bank Group"), (1, "nothing"), (2, "steel"), (2, "S05"), (2, "The Asia Bank Group"), (2, "%")]
    m = spark.createDataFrame(master, "symbol STRING, organ_name STRING")
    q = spark.createDataFrame(mentions, "call_id INT, mention STRING")
    got = {}
    for r in entities.resolve_entities(q, m, most=20).collect():
        got.setdefault(r.call_id, []).append((not r.exact, r.symbol))
    assert [s for _, s in sorted(got[1])] == ["ACB", "VNM"]
    assert [s for _, s in sorted(got[2])] == ["S05", "B%", "S00", "S01", "S02", "S03", "S04"] + [f"S{i:02d}" for i in range(6, 19)]
    assert entities.resolve_entities(q, m).filter("call_id = 2").count() == 31
    left = sorted(tuple(r) for r in entities.unresolved_entities(q, m).select("call_id", "mention").collect())
    assert left == [(1, "nothing"), (2, "The Asia Bank Group")]


def test_names_are_not_broadcast(spark, tmp_path):
    """Their files are small, the rows and grams read from them are not."""
    spark.range(2000).selectExpr("concat('S', id) AS symbol", "concat('Steel ', id) AS organ_name", "'x' AS sector").write.parquet(f"{tmp_path}/m")
    spark.createDataFrame([(1, "S7"), (1, "eel 19"), (1, "The Steel 3 Group")], "call_id INT, mention STRING").write.parquet(f"{tmp_path}/q")
    m, q = (spark.read.parquet(f"{tmp_path}/{t}") for t in "mq")
    found = entities.resolve_entities(q, m, m.select("symbol", "sector"))
    left = entities.unresolved_entities(q, m)
    for df in (found, left):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(r"BroadcastHashJoin \[[^\]]*\], \[[^\]]*\b(?:symbol|salt|name)#", plan)
    assert found.filter("symbol = 'S7' AND exact").count() == 1 and found.count() == 112
    assert left.count() == 1


def test_first_spellings(spark):
    df = spark.createDataFrame([(["B", "a", "b", "A", "c", "B"],), ([],), (None,)], "w ARRAY<STRING>")
    assert [r.v for r in df.select(arrays.first_spellings(F.col("w")).alias("v")).collect()] == [["B", "a", "c"], [], None]


def test_words_of_documents_with_one_row_are_not_shuffled(spark, tmp_path):
    from quarry.plans import QUERIES

    texts = [(i, " ".join(f"W{j} w{j}" for j in range(i % 40))) for i in range(200)] + [(7, "x W3 X"), (None, "b B"), (None, "c b"), (300, None), (301, " ")]
    spark.createDataFrame(texts, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    before, spark_rows = {}, QUERIES["dedupe_list"](spark, str(tmp_path))
    for doc, text in texts:
        for at, word in enumerate((text or "").split()):
            own = before.setdefault(doc, {})
            own[word.lower()] = min(own.get(word.lower(), (at, word)), (at, word))
    assert {r.doc_id: r.n for r in spark_rows.collect()} == {d: len(w) for d, w in before.items()}
    md5 = lambda w: hashlib.md5(" ".join(x for _, x in sorted(w.values())).encode()).hexdigest()
    assert {r.doc_id: r.words_md5 for r in spark_rows.collect()} == {d: md5(w) for d, w in before.items()}
    plan = spark_rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" in plan


def test_topic_change_rule(spark):
    said = [
        (1, 0, "user", "banking profits rising quickly"),
        (1, 1, "assistant", "indeed"),
        (1, 2, "user", "banking profits falling quickly"),
        (1, 3, "user", "weather forecast tomorrow"),
        (1, 4, "user", "weather forecast tomorrow"),
        (1, 5, "user", "hi"),
        (2, 0, "user", "weather forecast tomorrow"),
    ]
    df = spark.createDataFrame(said, "session_id INT, num_order INT, role STRING, text STRING")
    got = {(r.session_id, r.num_order): r.changed for r in conversation.topic_change(df).collect()}
    # Message 4 repeats message 3, which is therefore not counted as history.
    assert got == {(1, 0): False, (1, 2): False, (1, 3): True, (1, 4): True, (1, 5): False, (2, 0): False}


def test_next_order_of_empty_session(spark, rows):
    events = spark.createDataFrame([("a", 3), ("a", 9)], "session_id STRING, num_order INT")
    sessions = spark.createDataFrame([("a",), ("b",)], "session_id STRING")
    assert rows(conversation.next_order(events, sessions)) == [("a", 10), ("b", 1)]


def test_token_rows(spark):
    data = [
        ("rag", 0, "t1", "A", 10, 5, 15), ("rag", 1, "t1", None, 10, 5, 0), ("db", 0, "t1", "B", 1, 1, 2),
        ("db", 1, None, "", 1, 1, 2), ("other", 0, "t9", "Z", 9, 9, 9), ("web", 0, "t2", "C", None, None, None),
    ]
    schema = "component STRING, line INT, test_id STRING, category STRING, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT"
    rows = tokens.usage_rows(spark.createDataFrame(data, schema))
    by = {r.component: r for r in tokens.by_component(rows).collect()}
    assert (by["rag"]["count"], by["rag"].with_usage, by["rag"].total_sum, by["web"].total_max) == (2, 1, 15.0, 0.0)
    turns = {r.test_id: (r.category, r.total) for r in tokens.per_turn(rows).collect()}
    assert turns == {"t1": ("A", 17), "?": ("(uncategorised)", 2), "t2": ("C", 0)}
    average = tokens.component_average(rows).first()
    assert (average.rag, average.db, average.rewriter) == (5.0, 1.33, 0.0)


def test_quota_and_likert(spark):
    assert sum(evaluation.bucket_quota(59).values()) == 59
    assert list(evaluation.bucket_quota(11).values()) == [2, 2, 1, 1, 1, 1, 1, 1, 1]
    grades = spark.createDataFrame([("7",), ("-1",), ("x",), ("3",), (None,)], "g STRING")
    assert [r.v for r in grades.select(evaluation.likert(F.col("g")).alias("v")).collect()] == [1.0, 0.0, 0.0, 0.6, 0.0]


def test_claim_rules_for_empty_inputs(spark):
    cases = [
        ("full", "a", "r", 7, True), ("nochunks", "a", "r", 0, False), ("blank", " ", "r", 0, False),
        ("noref", "a", None, 2, True), ("noclaims", "a", "r", 2, True), ("blankchunks", "", "r", 2, True),
    ]
    verdicts = [("full", "context_precision", i, 1.0 if i < 4 else 0.0) for i in range(7)]
    verdicts += [("full", m, 0, 1.0) for m in ("context_recall", "faithfulness")] + [("full", "answer_faithfulness", i, i / 1.0) for i in (0, 1)]
    verdicts += [("nochunks", m, 0, 1.0) for m in ("context_recall", "answer_faithfulness", "faithfulness")]
    c = spark.createDataFrame(cases, "case_id STRING, answer STRING, reference_answer STRING, n_chunks INT, has_context BOOLEAN")
    v = spark.createDataFrame(verdicts, "case_id STRING, metric STRING, item_no INT, score DOUBLE")
    got = {r.case_id: tuple(r)[1:] for r in evaluation.claim_metrics(c, v).collect()}
    assert got == {
        "full": (0.8, 1.0, 0.5, 1.0),
        "nochunks": (0.0, 0.0, 0.0, 0.0),
        "blank": (0.0, 1.0, 1.0, 1.0),
        "noref": (0.0, 1.0, 1.0, 0.0),
        "noclaims": (0.0, 1.0, 1.0, 0.0),
        "blankchunks": (0.0, 1.0, 0.0, 1.0),
    }


def test_citations_and_language(spark):
    cite = lambda a, s: one(spark, evaluation.citation_validity(F.col("a"), F.col("s")), "a STRING, s ARRAY<INT>", (a, s))
    assert cite("none", []) == 1.0
    assert cite("[1] [1] [9]", [1, 2]) == pytest.approx(2 / 3)
    assert cite("[1]", []) == 0.0
    assert cite("[99999999999999]", [1]) == 0.0
    clean = lambda a: one(spark, evaluation.language_clean(F.col("x")), "x STRING", (a,))
    assert [clean(a) for a in ("fine", "fine 中", "ok\n  ## Head", "# a Ж", "", None, "#tag")] == [1.0, 0.4, 0.6, 0.0, 0.0, 0.0, 1.0]


def test_a_layer_without_scores_averages_to_zero(spark, rows):
    """Two layers have scores, one metric of them none; the third layer is empty."""
    from quarry.operators import evaluation

    summary = spark.createDataFrame([("e2e.a", 0.5), ("e2e.b", 1.0), ("rag.a", 0.25)], "metric string, mean double")
    assert rows(evaluation.layer_averages(summary)) == [("agent", 0.0), ("e2e", 0.75), ("rag", 0.25)]
    scores = spark.createDataFrame([("e2e", {"a": 1.0}), ("e2e", {"a": None}), ("rag", {"b": None}), ("agent", {})], "layer string, metrics map<string, double>")
    assert rows(evaluation.score_summary(scores.selectExpr("1 AS id", "*")))[0][0] == "e2e.a"


def test_names_inside_texts_in_parts(spark, rows):
    """Nested, overlapping and repeated names, any number of parts, hot texts, empty and null values."""
    from quarry.operators.entities import names_inside

    names = ["bank", "an", "big bank of x", "of", "", None, "zz", "ünï", "an"]
    texts = ["the big bank of x", "bank bank", "nothing", "", None, "ünïon"] + ["can"] * 50
    want = sorted({(t, n) for t in texts if t for n in names if n and n in t})
    frames = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string")
    for chars in ((1000, 1000), (20, 1000), (1000, 30), (20, 30)):
        assert rows(names_inside(*frames, *chars)) == want
    assert names_inside(frames[0], frames[1].limit(0)).count() == 0 == names_inside(frames[0].limit(0), frames[1]).count()
