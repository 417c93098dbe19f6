import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.sources import csv, documents, pages, sqlite, warehouse
from quarry.sources import json as json_source


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "house.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE income_statement (id INTEGER, symbol TEXT, year INT, quarter INT, revenue REAL, created_at DATE)")
        db.executemany(
            "INSERT INTO income_statement VALUES (?, ?, ?, ?, ?, ?)",
            [(i, f"S{i % 7}", 2020, None if i % 5 == 0 else i % 4, i * 1.5, "2018-05-07" if i % 2 else "soon") for i in range(1, 101)],
        )
        db.execute("CREATE TABLE stranger (x INT)")
        db.execute("CREATE TABLE stocks (id INTEGER, ticker TEXT, \"organ name\" TEXT)")
        db.execute("CREATE TABLE exchanges (exchange TEXT)")
        db.executemany("INSERT INTO stocks VALUES (?, ?, ?)", [(1, "A", "Alpha"), (None, "B", None)])
    return path


def test_sqlite_is_read_in_ranges(spark, database):
    assert sqlite.list_tables(database) == ["exchanges", "income_statement", "stocks", "stranger"]
    df = sqlite.read_sqlite(spark, database, "income_statement", "id", 8)
    assert dict(df.dtypes)["created_at"] == "string" and dict(df.dtypes)["revenue"] == "double"
    assert df.rdd.getNumPartitions() == 8
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 100
    assert df.agg(F.sum("id"), F.countDistinct("id")).first() == (5050, 100)
    assert sqlite.read_sqlite(spark, database, "exchanges", "exchange").rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, database, "absent")


@pytest.mark.parametrize("low, high, parts, want", [(None, None, 8, 1), (5, 5, 8, 1), (1, 3, 8, 2), (0, 100, 8, 8), (0, 9, 1, 1)])
def test_ranges_cover_everything_once(low, high, parts, want):
    ranges = sqlite.split_range(low, high, parts)
    assert len(ranges) == want and ranges[0].low is None and ranges[-1].high is None
    assert all(a.high == b.low for a, b in zip(ranges, ranges[1:]))


def test_all_tables_are_loaded_and_audited(spark, database, tmp_path):
    out = str(tmp_path / "warehouse")

    def read(table):
        column = warehouse.RANGE_READ_COLUMN.get(table)
        return warehouse.clean_warehouse_rows(sqlite.read_sqlite(spark, database, table, column), table)

    loads = [
        warehouse.Load("m", t, database, "sqlite", 10, lambda t=t: read(t)) for t in [*sqlite.list_tables(database), "news"]
    ]
    audit = warehouse.load_tables(spark, loads, lambda df, t: warehouse.append(df, f"{out}/{t}"))
    got = {r.table_name: (r.row_count, r.status) for r in audit.collect()}
    assert got == {"exchanges": (0, "success"), "income_statement": (100, "success"), "stocks": (2, "success"), "news": (0, "failed")}
    assert warehouse.write_audit(audit, str(tmp_path / "audit")) and spark.read.parquet(str(tmp_path / "audit")).count() == 4
    assert not warehouse.write_audit(audit.withColumn("bad name", F.expr("raise_error('no')")), str(tmp_path / "audit2"))
    stocks = spark.read.parquet(f"{out}/stocks")
    assert stocks.columns == ["ticker", "organ_name"]
    income = spark.read.parquet(f"{out}/income_statement")
    assert income.filter("quarter IS NULL").count() == 0 and income.filter("quarter = 0 AND id % 5 = 0").count() == 20
    assert {str(r[0]) for r in income.select("created_at").distinct().collect()} == {"2018-05-07 00:00:00", "1970-01-01 00:00:00"}


def test_csv_edges(spark, tmp_path):
    path = tmp_path / "cash_dividend.csv"
    path.write_text(
        'Ticker,Ex Rate,pay_date,symbol,Year,Duration,Extra\n'
        'ABC,"1,234.5",07/05/2024,second,2024,"two\nlines, ""quoted""",x\n'
        ',bad,nonsense,second,20x4,,\n'
    )
    assert csv.target_of(str(path)) == "cash_dividend" and csv.target_of("/x/other.csv") is None
    got = csv.read_shaped_csv(spark, str(path), "cash_dividend").collect()
    assert got[0].symbol == "ABC" and got[0].exercise_rate == 1234.5 and str(got[0].payment_date) == "2024-05-07"
    assert got[0].duration == 'two\nlines, "quoted"' and got[0].dividend_year == 2024
    assert (got[1].symbol, got[1].exercise_rate, got[1].payment_date, got[1].dividend_year) == ("UNKNOWN", None, None, None)
    assert "Extra" not in got[0].asDict() and "extra" not in got[0].asDict()
    subs = tmp_path / "subsidiaries.csv"
    subs.write_text("Ticker,Name,Ownership (%)\nA,Sub,51.5\nB,Other,\n")
    rows = csv.read_shaped_csv(spark, str(subs), "subsidiaries").collect()
    assert len({r.id for r in rows}) == 2 and all(len(r.id) == 36 for r in rows)
    empty = tmp_path / "stock_dividend.csv"
    empty.write_text("symbol,plan_volume\n")
    assert csv.read_shaped_csv(spark, str(empty), "stock_dividend").count() == 0


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    files = {
        "a.txt": "plain é".encode(),
        "sub/b.MD": "﻿marked".encode(),
        "sub/c.txt": "caf\xe9".encode("latin-1"),
        "d.tar.gz": b"\x00\x01",
        "noext": b"x",
        ".hidden.txt": b"x",
        ".git/e.txt": b"x",
        "OLAP/f.txt": b"x",
        "sub/tmp/g.txt": b"x",
        "logs.txt": b"kept",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root


def test_documents_are_scanned_and_decoded(spark, folder):
    class Reverse:
        def load(self):
            pass

        def parse(self, content):
            return content[::-1].hex()

    scanned = documents.scan_documents(spark, str(folder))
    got = {r.path: r for r in documents.parse_documents(scanned, {"gz": Reverse()}).collect()}
    assert set(got) == {"a.txt", "sub/b.MD", "sub/c.txt", "d.tar.gz", "noext", "logs.txt"}
    assert {p: r.file_type for p, r in got.items()}["d.tar.gz"] == "gz" and got["noext"].file_type == ""
    assert (got["a.txt"].text, got["sub/b.MD"].text, got["sub/c.txt"].text) == ("plain é", "﻿marked", "café")
    assert got["d.tar.gz"].text == "0100" and got["noext"].text is None
    assert got["a.txt"].file_bytes == 8 and len(got["a.txt"].file_hash) == 64


def test_json_lines_and_cases(spark, tmp_path):
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"test_id": "a", "usage": {"total_tokens": 3}}\n\n{"test_id": "b"\nnot json\n{"test_id": "c"}\n')
    got = json_source.read_jsonl(spark, str(lines), json_source.LOG_SCHEMA)
    assert sorted((r.test_id, r.usage and r.usage.total_tokens) for r in got.collect()) == [("a", 3), ("c", None)]
    assert json_source.malformed_lines(spark, str(lines)).count() == 2
    cases = [{"id": "B-1", "key_facts": ["x"]}, {"id": "B-2", "history": [{"role": "user", "content": "hi"}]}]
    (tmp_path / "array.json").write_text(json.dumps(cases))
    (tmp_path / "items.json").write_text(json.dumps({"note": 1, "items": cases[:1]}))
    assert [r.id for r in json_source.read_cases(spark, str(tmp_path / "array.json")).orderBy("id").collect()] == ["B-1", "B-2"]
    assert [r.id for r in json_source.read_cases(spark, str(tmp_path / "items.json")).collect()] == ["B-1"]


def test_pages(spark):
    html = (
        "<html><head><title> A &amp; B </title><style>x</style></head><body><nav>menu<p>m</p></nav><h1>Head</h1>"
        "<p>One  \t two</p><br><br><br><p>Three<script>bad()</script></p></footer><form>f</form>end</body>"
    )
    data = [("https://a", html), (" http://b ", "x" * 50), ("ftp://c", html), ("", html), (None, html), ("http://d", None)]
    df = spark.createDataFrame(data, "url STRING, html STRING")
    got = {r.url: r for r in pages.pages_to_text(df, max_chars=40).collect()}
    first = got["https://a"]
    assert (first.title, first.truncated, first.error) == ("A & B", False, None)
    assert first.text == "Head \nOne \t two \n\nThree end".replace(" \t ", " ")
    assert got["http://b"].truncated and len(got["http://b"].text) == 40
    assert got["ftp://c"].error == "only http/https schemes are allowed" and got["ftp://c"].text == ""
    assert got[""].error == "empty url" and got["http://d"].text == ""

    class Broken:
        def extract(self, page):
            raise ValueError("no")

    assert pages.pages_to_text(df.limit(1), Broken()).first().error == "html parse failed: no"


def test_csv_with_quoted_line_breaks_is_read_in_parts(spark, tmp_path):
    """One file over many tasks: the same rows as in one task, whatever stands at the cuts."""
    import csv as plain
    import io
    import random

    rng = random.Random(11)
    bits = ["a", "b,c", 'say ""hi""'.replace('""', '"'), "line\nbreak", "two\n\nbreaks", "", "é", "x" * 300, "\n" * 40, '"', " pad "]
    rows = [[str(i), *("".join(rng.choices(bits, k=rng.randint(0, 3))) for _ in range(3))] for i in range(400)]
    text = io.StringIO()
    plain.writer(text, lineterminator="\r\n").writerows([["id", "first name", "b", "id"], *rows])
    for name in ("one.csv", "two.csv"):
        (tmp_path / name).write_text(text.getvalue() + ("\r\n" if name == "two.csv" else ""), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(map(tuple, csv.read_csv(spark, str(tmp_path)).collect()), key=str)
    assert len(want) == 800
    try:
        for size in ("200b", "1000b", "100000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = csv.read_split_csv(spark, str(tmp_path))
            assert found.columns == csv.read_csv(spark, str(tmp_path)).columns
            assert sorted(map(tuple, found.collect()), key=str) == want, size
            if size == "200b":
                assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_arrays_are_read_in_parts(spark, tmp_path):
    """Arrays and objects with `items` over many tasks: the same cases as in one task, whatever stands at the cuts."""
    import random

    rng = random.Random(12)
    words = ["plain", "}", "{", "[", "]", '"', "\\", "a: b", "}}{", '\\"}', "é}", "items", "x" * 200, ""]
    said = lambda: "".join(rng.choices(words, k=rng.randint(0, 4)))

    def case(i):
        chart = {"chart_type": [said()], "filters": {"a}": said()}} if i % 3 == 0 else None
        return {"id": f"B-{i}", "question": said(), "history": [{"role": "user", "content": said()}], "key_facts": [said(), said()], "expected_chart": chart}

    cases = [case(i) for i in range(300)]
    (tmp_path / "array.json").write_text(json.dumps(cases[:100], ensure_ascii=False, indent=1))
    (tmp_path / "line.json").write_text("  " + json.dumps(cases[100:200]))
    others = {"note": [{"id": "no"}, {"items": [{"id": "no"}]}], "more": {"items": [{"id": "no"}]}, "items": cases[200:], "last": [{"id": "no"}]}
    (tmp_path / "items.json").write_text(json.dumps(others))
    (tmp_path / "empty.json").write_text("[]")
    show = lambda df: sorted(str(r) for r in df.collect())
    want = show(json_source.read_cases(spark, str(tmp_path)).filter("id IS NOT NULL"))
    assert len(want) == 300 and not any("id='no'" in w for w in want)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("400b", "3000b", "1000000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert show(json_source.read_split_cases(spark, str(tmp_path))) == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_page_segments_do_not_show(spark):
    """Skipped tags, titles and lines that reach over segments, unclosed and stray tags, no tags at all."""
    import random

    rng = random.Random(3)
    bits = ["<nav>", "</nav>", "<title>", "</title>", "<p>", "</p>", "<br/>", "text ", " &lt;x&gt; ", "<", "<!doctype>", "<form>", "</form>", "<div>", "\n"]
    data = ["".join(rng.choices(bits, k=n)) for n in (1, 2, 5, 30, 60, 90, 200) for _ in range(6)]
    data += ["", "plain", "<<<", "a < b > c", "<nav>" * 9 + "x" + "</nav>" * 9 + "y", "</nav>x<nav>y</nav>z"]
    df = spark.createDataFrame(list(enumerate(data)), "i int, html string")
    views = [{r["i"]: tuple(r["p"]) for r in df.select("i", pages.visible_text(F.col("html"), size).alias("p")).collect()} for size in (1, 3, 16, 1000)]
    assert views[0] == views[1] == views[2] == views[3]
    assert views[0][len(data) - 1] == ("", "x z") and views[0][len(data) - 2] == ("", "y")


def test_page_time_grows_with_the_page(spark):
    import time

    def seconds(tags):
        df = spark.createDataFrame([("<p>word &amp; more</p>" * (tags // 2),)], "html string")
        started = time.perf_counter()
        assert df.select(pages.visible_text(F.col("html")).alias("p")).first()["p"]["text"].count("more") == tags // 2
        return time.perf_counter() - started

    seconds(1000)
    short = min(seconds(40_000) for _ in range(2))
    assert seconds(160_000) < 6 * short  # a fold that copies takes sixteen times as long


def test_month_folders_are_pruned_and_hot_months_split(spark, tmp_path):
    hot = spark.range(4000).select(
        F.lit("A").alias("symbol"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 40000 AS INT))").alias("time"), "id"
    )
    cold = spark.range(10).select(F.lit("B").alias("symbol"), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'").alias("time"), "id")
    path = str(tmp_path / "ticks")
    warehouse.append_by_month(hot.union(cold), path, "time", tasks=4)
    back = spark.read.parquet(path)
    assert back.count() == 4010
    january = [f for f in back.inputFiles() if "yyyymm=202401" in f]
    assert len(january) > 1
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-02-01 00:00:00", "2024-02-02 00:00:00"))
    recent = warehouse.in_months(back, "time", start, end)
    assert recent.count() == 10
    assert "yyyymm" in recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]


def test_component_logs(spark, tmp_path):
    df = spark.createDataFrame([("rag", 1), (None, 2), ("", 3)], "component STRING, x INT")
    warehouse.append_component_logs(df, str(tmp_path))
    assert sorted(p.name for p in tmp_path.glob("component=*")) == ["component=rag", "component=unknown"]


def test_character_references(spark):
    """Every HTML5 name and the rules for numbers, against the standard library."""
    import html
    from html.entities import html5

    from pyspark.sql import functions as F

    texts = ["".join(f"[&{n}]" for n in html5), "&eacute; &uuml &szligx &zwj; &unknown; &#233 &#x00000e9; &#150; &#0; &#xD800; &#99999999999; &#x1F600; &# & &;"]
    texts += ["&amp;lt; &lt; &copy &copy; &notit; &notin;", "&#1; &#65534; &#13; &#x80;", "none", "&"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pages.unescape(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in found] == [html.unescape(r["t"]) for r in found]
