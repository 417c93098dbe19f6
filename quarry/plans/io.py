"""Queries that go through files or streams.

Inputs are written by Spark from the given tables to the shared folder, read
back by the source or stream under test, and returned.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import tokens
from quarry.plans.registry import query
from quarry.plans.structured import LATEST_LINEITEM
from quarry.plans.tables import FILES, LOGS, MONTH_TICKS, TICKS, day_text
from quarry.session import scratch_path, spread
from quarry.sources import csv, documents, json, pages, warehouse
from quarry.streaming import bars, batches, documents as document_streams, manifests, sequence, upsert

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


# Files -----------------------------------------------------------------------------
CSV_SHAPE = """
    SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'UNKNOWN' ELSE s_name END AS symbol, '2024-05-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS record_date,
           CAST(floor(s_acctbal) AS DOUBLE) AS dps, CAST(2000 + s_nationkey AS DOUBLE) AS dividend_year, 'two' || chr(10) || 'lines "q"' AS duration
    FROM supplier
    """


@query("src_csv_shape", CSV_SHAPE)
def _src_csv_shape(data):
    path = _dividend_export(data)
    return _dividends(csv.read_shaped_csv(data.spark, path, csv.target_of(path)))


@query("src_csv_split", CSV_SHAPE)
def _src_csv_split(data):
    """The same from files that several tasks read, though a field holds line breaks."""
    path = _dividend_export(data)
    return _dividends(csv.read_shaped_csv(data.spark, path, csv.target_of(path), split=True))


def _dividends(shaped):
    return shaped.select(
        "symbol", day_text("record_date").alias("record_date"), "dps", F.col("dividend_year").cast("double"), "duration"
    )


def _dividend_export(data) -> str:
    key = F.col("s_suppkey")
    day = F.make_date(F.lit(2024), F.lit(5), (key % 28 + 1).cast("int"))
    raw = data.table("supplier").select(
        F.when(key % 10 != 0, F.col("s_name")).alias("Ticker"),
        F.date_format(day, "dd/MM/yyyy").alias("Ex Date"),
        F.format_number(F.floor("s_acctbal"), 0).alias("Dividend.Per-Share"),
        (F.lit(2000) + F.col("s_nationkey")).cast("string").alias("Year"),
        F.lit('two\nlines "q"').alias(" Duration"),
        F.lit("x").alias("Unknown (%)"),
        F.lit("second").alias("SYMBOL"),
    )
    path = scratch_path(data.spark, "csv") + "/cash_dividend.csv"
    raw.write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
    return path


@query(
    "src_jsonl",
    """
    SELECT role AS component, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations GROUP BY 1
    """,
)
def _src_jsonl(data):
    """Every record is followed by a blank line and a broken one."""
    record = F.struct(F.col("role").alias("component"), F.struct(F.length("text").cast("long").alias("total_tokens")).alias("usage"))
    good = F.to_json(record)
    lines = data.table("conversations").select(
        F.explode(F.array(good, F.lit("   "), F.substring(good, 1, 12))).alias("value")
    )
    path = scratch_path(data.spark, "jsonl")
    lines.write.text(path)
    logs = json.read_jsonl(data.spark, path, json.LOG_SCHEMA)
    return logs.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("usage.total_tokens").alias("total"))


@query(
    "logs_to_tokens",
    """
    SELECT role AS component, count(*) AS count, CAST(sum(length(text)) AS DOUBLE) AS total_sum FROM conversations GROUP BY 1
    """,
)
def _logs_to_tokens(data):
    """Logs written as nested JSON lines, read back and summed per component."""
    size = F.length("text").cast("long")
    usage = F.struct(size.alias("total_tokens"), F.lit(0).alias("input_tokens"), size.alias("output_tokens"))
    record = F.struct(F.col("role").alias("component"), F.col("conv_id").cast("string").alias("test_id"), usage.alias("usage"))
    path = scratch_path(data.spark, "logs")
    data.table("conversations").select(F.to_json(record).alias("value")).write.text(path)
    rows = tokens.usage_rows(json.read_logs(data.spark, path), ("system", "user", "assistant"))
    return tokens.by_component(rows).select("component", "count", "total_sum")


CASE_FILES = """
    SELECT CAST(doc_id AS VARCHAR) AS id, lang AS table_name, 'a|' || source AS y_columns, length(text) AS chars FROM documents
    """


@query("read_cases", CASE_FILES)
def _read_cases(data):
    """Case files with chart fields, an array of cases per file."""
    return _case_fields(json.read_cases(data.spark, _case_folder(data)))


@query("read_cases_split", CASE_FILES)
def _read_cases_split(data):
    """The same from files that several tasks read, each some of the cases."""
    return _case_fields(json.read_split_cases(data.spark, _case_folder(data)))


def _case_fields(cases):
    return cases.select("id", F.col("expected_chart.table").alias("table_name"), F.array_join("expected_chart.y_columns", "|").alias("y_columns"), F.length("question").cast("long").alias("chars"))


def _case_folder(data) -> str:
    chart = F.struct(F.col("lang").alias("table"), F.array(F.lit("a"), "source").alias("y_columns"))
    case = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), chart.alias("expected_chart"))
    path = scratch_path(data.spark, "cases")
    # A file is one JSON array.
    part = F.floor(F.col("doc_id") / 50).alias("part")
    groups = data.table("documents").groupBy(part).agg(F.to_json(F.collect_list(case)).alias("value"))
    groups.write.partitionBy("part").text(path)
    return path


@query(
    "scan_folder",
    """
    SELECT lang, source, CAST(sum(strlen(lang || source || text) + 2) AS BIGINT) AS file_bytes, CAST(sum(length(lang || source || text) + 2) AS BIGINT) AS chars FROM documents GROUP BY 1, 2
    """,
)
def _scan_folder(data):
    """A folder of text files, scanned, hashed and decoded."""
    found = documents.parse_documents(documents.scan_documents(data.spark, _text_folder(data)))
    place = F.split("path", "/")
    folder = [F.element_at(F.split(F.get(place, k), "="), -1).alias(n) for k, n in ((0, "lang"), (1, "source"))]
    return found.select(*folder, "file_bytes", F.length("text").cast("long").alias("chars"))


def _text_folder(data) -> str:
    """The texts of every language and source in a file of their own, no two files alike."""
    path = scratch_path(data.spark, "texts")
    marked = F.concat("lang", "source", F.lit(" "), "text")
    texts = data.table("documents").select("lang", "source", marked.alias("text"))
    # Without a success marker, which would be one more file to scan.
    files = texts.repartition("lang", "source").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    files.partitionBy("lang", "source").text(path)
    return path


@query(
    "txt_decode",
    """
    SELECT doc_id, md5(CASE doc_id % 3 WHEN 1 THEN chr(65279) || text ELSE text END) AS text_md5 FROM documents
    """,
)
def _txt_decode(data):
    """UTF-8, UTF-8 with a byte order mark, and Latin-1 bytes of every text."""
    kind = F.col("doc_id") % 3
    marked = F.concat(F.lit("﻿"), F.col("text"))
    latin = ~F.col("text").rlike("[^\\x00-\\xff]") & F.col("text").rlike("[\\x80-\\xff]")
    content = (
        F.when(kind == 1, F.encode(marked, "UTF-8"))
        .when((kind == 2) & latin, F.encode("text", "ISO-8859-1"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    raw = data.table("documents").select("doc_id", content.alias("content"))
    return raw.select("doc_id", F.md5(documents.decode_text(F.col("content"))).alias("text_md5"))


@query(
    "pages_title",
    """
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS title FROM pages
    """,
)
def _pages_title(data):
    return pages.pages_to_text(spread(data.table("pages"))).select("page_id", "title")


@query(
    "pages_to_text",
    r"""
    WITH marked AS (
      SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '<x>', 'g'),
        '<[^>]*>|[^<]+') AS ts FROM pages),
    tokens AS (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM marked),
    tags AS (SELECT *, CASE WHEN t LIKE '<%' THEN lower(regexp_extract(t, '^</?([a-zA-Z0-9]*)', 1)) END AS tag,
                    t LIKE '</%' AS closing FROM tokens),
    deep AS (SELECT *, sum(CASE WHEN tag IN ('nav', 'footer', 'header', 'aside', 'form', 'title') THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END)
                       OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM tags),
    spelled AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;?', '"', 'g'),
                                              '&amp;?', '&', 'g'), E' \n\t') AS word FROM deep),
    bodies AS (
      SELECT page_id, string_agg(CASE WHEN tag IN ('p', 'br', 'li', 'h1', 'h2', 'h3', 'h4') AND NOT closing THEN chr(10)
                                      WHEN tag IS NULL AND depth = 0 AND word <> '' THEN word || ' ' ELSE '' END, '' ORDER BY pos) AS body
      FROM spelled GROUP BY 1),
    texts AS (SELECT page_id, trim(regexp_replace(regexp_replace(body, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), E' \n\t') AS text FROM bodies)
    SELECT page_id, url, text, false AS truncated, 'none' AS error FROM texts JOIN pages USING (page_id)
    """,
)
def _pages_to_text(data):
    text = pages.pages_to_text(spread(data.table("pages")))
    return text.select("page_id", "url", "text", "truncated", F.coalesce("error", F.lit("none")).alias("error"))


@query(
    "sink_append",
    """
    SELECT c_mktsegment, 2 * count(*) AS n FROM customer GROUP BY 1
    """,
)
def _sink_append(data):
    """The same rows appended twice."""
    path = scratch_path(data.spark, "append")
    for _ in range(2):
        warehouse.append(data.table("customer"), path)
    return data.spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "append_twice_same_batch",
    "SELECT c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END * count(*) AS n FROM customer GROUP BY 1",
)
def _append_twice_same_batch(data):
    """The same file and batch twice, and one segment once more in another batch."""
    path = scratch_path(data.spark, "once")
    customers = data.table("customer")
    for _ in range(2):
        warehouse.append_once(customers, path, "customer.parquet", "b1")
    warehouse.append_once(customers.filter("c_mktsegment = 'BUILDING'"), path, "customer.parquet", "b2")
    return data.spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink_month_partitions",
    f"""
    WITH {MONTH_TICKS} SELECT CAST(year(time) * 100 + month(time) AS BIGINT) AS yyyymm, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume
    FROM month_ticks WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-03-20' GROUP BY 1
    """,
)
def _sink_month_partitions(data):
    path = scratch_path(data.spark, "ticks")
    warehouse.append_by_month(data.month_ticks(), path, "time")
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05 00:00:00", "2024-03-20 00:00:00"))
    recent = warehouse.in_months(data.spark.read.parquet(path), "time", start, end)
    return recent.groupBy(F.col("yyyymm").cast("long").alias("yyyymm")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")
    )


@query(
    "sink_component_logs",
    f"""
    WITH {LOGS} SELECT CASE WHEN component = 'system' THEN 'unknown' ELSE component END AS component, count(*) AS n FROM logs GROUP BY 1
    """,
)
def _sink_component_logs(data):
    path = scratch_path(data.spark, "logs")
    logs = data.logs().withColumn("component", F.when(F.col("component") != "system", F.col("component")))
    warehouse.append_component_logs(logs, path)
    return data.spark.read.json(path).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingest_audit",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, 'success' AS status FROM {t}" for t in TABLES
    )
    + " UNION ALL SELECT 'broken', 0, 'failed'",
)
def _ingest_audit(data):
    """All tables loaded into a warehouse folder, one unknown and one unreadable."""
    path = scratch_path(data.spark, "warehouse")
    sources = {t: f"{data.sf_dir}/{t}.parquet" for t in (*TABLES, "stranger", "broken")}
    loads = [
        warehouse.Load("m1", t, source, "parquet", 0, lambda source=source: data.spark.read.parquet(source))
        for t, source in sources.items()
    ]
    write = lambda df, t: warehouse.append(df, f"{path}/{t}")
    audit = warehouse.load_tables(data.spark, loads, write, known=frozenset((*TABLES, "broken")))
    return audit.select("table_name", "row_count", "status")


# Streams ------------------------------------------------------------------------------
def _stream(data, path: str, batches_wanted: int = 1):
    """A stream over the parquet files of a folder, drained in about so many batches."""
    files = data.spark.read.parquet(path)
    per_batch = -(-len(files.inputFiles()) // batches_wanted)
    return data.spark.readStream.schema(files.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


@query(
    "stream_upsert",
    f"""
    WITH {LATEST_LINEITEM}
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity FROM latest
    """,
)
def _stream_upsert(data):
    """Lines arrive by quantity, so versions of a key are spread over batches."""
    lines = data.table("lineitem")
    path = scratch_path(data.spark, "lines")
    lines.repartitionByRange("l_quantity").write.parquet(path)
    out = scratch_path(data.spark, "upsert")
    upsert.append_stream(_stream(data, path, 3), f"{out}/rows", f"{out}/checkpoint")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields)
    keys, tie = ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    table = upsert.versioned(data.spark, f"{out}/rows", schema, keys, "l_shipdate", tie)
    return table.read().select("l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "l_quantity")


@query(
    "stream_sequence",
    """
    SELECT conv_id AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS num_order FROM conversations
    """,
)
def _stream_sequence(data):
    """Turns arrive in three parts, earlier ones first; the job runs after each part."""
    said = data.table("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role")
    turn = F.col("turn")
    path, out = scratch_path(data.spark, "turns"), scratch_path(data.spark, "numbered")
    for part in (turn < 2, (turn >= 2) & (turn < 5), turn >= 5):
        said.filter(part).write.mode("append").parquet(path)
        sequence.number_stream(_stream(data, path), turn, F.floor(turn / 100_000), out, f"{out}/checkpoint")
    numbered = batches.read_batches(data.spark, f"{out}/events", "session_id BIGINT, turn BIGINT, role STRING, num_order BIGINT")
    return numbered.select("session_id", "turn", "num_order")


@query(
    "stream_bars",
    f"""
    WITH {TICKS}, last AS (SELECT max(time) - INTERVAL 1 HOUR AS mark FROM ticks)
    SELECT symbol, strftime(date_trunc('day', time), '%Y-%m-%d') AS day, arg_min(price, time) AS open, max(price) AS high,
           min(price) AS low, arg_max(price, time) AS close, CAST(sum(volume) AS BIGINT) AS volume
    FROM ticks, last WHERE date_trunc('day', time) + INTERVAL 1 DAY <= mark GROUP BY 1, 2
    """,
)
def _stream_bars(data):
    path = scratch_path(data.spark, "ticks")
    data.ticks().write.parquet(path)
    out = scratch_path(data.spark, "bars")
    bars.write_bars(bars.bar_stream(_stream(data, path), "1 day"), f"{out}/bars", f"{out}/checkpoint")
    emitted = data.spark.read.parquet(f"{out}/bars")
    return emitted.select("symbol", day_text("time").alias("day"), "open", "high", "low", "close", "volume")


@query(
    "stream_scan",
    "SELECT 'processed' AS decision, 'ready' AS process_status, count(*) AS files FROM (SELECT DISTINCT lang, source FROM documents)",
)
def _stream_scan(data):
    """Every file of a folder is decided once, also when the job runs again."""
    folder, out = _text_folder(data), scratch_path(data.spark, "scan")
    for _ in range(2):
        document_streams.scan_stream(document_streams.document_stream(data.spark, folder), f"{out}/catalog", f"{out}/checkpoint")
    entries = document_streams.catalog(data.spark, f"{out}/catalog")
    return entries.groupBy("decision", "process_status").agg(F.count(F.lit(1)).alias("files"))


@query(
    "stream_scan_arrivals",
    """
    WITH f AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) % 3 AS project_id, lang FROM documents)
    SELECT project_id, 0 AS arrival, 'processed' AS decision, CASE WHEN lang = 'de' THEN 'failed' ELSE 'ready' END AS process_status, count(*) AS files FROM f GROUP BY ALL
    UNION ALL
    SELECT project_id, 1, CASE WHEN lang = 'de' THEN 'retried' ELSE 'skipped' END, CASE WHEN lang = 'de' THEN 'failed' ELSE 'none' END, count(*) FROM f GROUP BY ALL
    """,
)
def _stream_scan_arrivals(data):
    """A file per project and language arrives twice under other names; those in German cannot be ingested."""
    root, out = scratch_path(data.spark, "arrivals"), scratch_path(data.spark, "scan")
    texts = data.table("documents").select("doc_id", "lang", "text", (F.expr("CAST(substr(source, 4) AS BIGINT)") % 3).alias("project"))
    for arrival in ("first", "again"):
        for project in range(3):
            own = texts.filter(F.col("project") == project).repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", "text")
            files = own.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
            files.partitionBy("lang").text(f"{root}/project_{project}/{arrival}")
        stream = document_streams.document_stream(data.spark, root)
        document_streams.scan_stream(stream, f"{out}/catalog", f"{out}/checkpoint", _ingest_but_german)
    entries = batches.read_batches(data.spark, f"{out}/catalog", document_streams.CATALOG_SCHEMA)
    status = F.coalesce("process_status", F.lit("none")).alias("process_status")
    return entries.groupBy("project_id", F.col("batch_id").alias("arrival"), "decision", status).agg(F.count(F.lit(1)).alias("files"))


def _ingest_but_german(files):
    return files.select("file_hash", F.when(F.contains("path", F.lit("lang=de/")), "failed").otherwise("ready").alias("status"))


@query(
    "manifests",
    """
    SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'failed' ELSE 'processed' END AS status,
           CASE WHEN n_nationkey % 5 = 0 THEN 'missing field: table_name' ELSE 'none' END AS reason, count(*) AS n
    FROM nation GROUP BY 1, 2
    """,
)
def _manifests(data):
    """A manifest file per nation, some without a table name."""
    path, out = scratch_path(data.spark, "manifests"), scratch_path(data.spark, "outcomes")
    key = F.col("n_nationkey")
    fields = data.table("nation").select(
        key, F.concat(F.lit("/in/"), "n_name").alias("file_path"), F.lit("csv").alias("file_type"), F.when(key % 5 != 0, F.col("n_name")).alias("table_name")
    )
    fields.write.partitionBy("n_nationkey").json(path)
    manifests.process_manifests(manifests.manifest_stream(data.spark, path), lambda _: None, f"{out}/log", f"{out}/checkpoint")
    log = batches.read_batches(data.spark, f"{out}/log", manifests.LOADED_SCHEMA)
    return log.groupBy("status", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_dedup",
    f"WITH {FILES} SELECT DISTINCT project_id, file_hash FROM files",
)
def _stream_dedup(data):
    path = scratch_path(data.spark, "uploads")
    uploads = data.files().select("project_id", "file_hash", "file_id", F.col("process_at").cast("timestamp").alias("uploaded_at"))
    uploads.write.parquet(path)
    out = scratch_path(data.spark, "first")
    fresh = document_streams.first_uploads(_stream(data, path, 3), "36500 days")
    batches.run_batches(fresh, lambda rows, n: batches.write_batch(rows, f"{out}/rows", n), f"{out}/checkpoint")
    return batches.read_batches(data.spark, f"{out}/rows", "project_id BIGINT, file_hash STRING").select("project_id", "file_hash")
