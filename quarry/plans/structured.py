"""Queries for the single-table API, projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import arrays, dates, numeric, text
from quarry.operators import cleaning, evaluation, statements
from quarry.operators.query import aggregate, distinct_values, select_rows, where
from quarry.operators.ranking import nearest_rank
from quarry.plans.registry import query
from quarry.plans.tables import FILES, STATEMENT, day_text, sql_round, time_text
from quarry.session import scratch_path, spread
from quarry.sources.versioned import VersionedTable

LATEST_LINEITEM = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn
    FROM lineitem) WHERE rn = 1)
"""


# Latest versions and the query API ------------------------------------------
@query(
    "latest_version",
    f"""
    WITH {LATEST_LINEITEM}
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity,
           strftime(l_shipdate, '%Y-%m-%d') AS ship_day FROM latest
    """,
)
def _latest_version(data):
    latest = data.lineitem_versions().read()
    return latest.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long"),
        "l_partkey",
        "l_quantity",
        day_text("l_shipdate").alias("ship_day"),
    )


@query(
    "latest_version_stored",
    f"""
    WITH {LATEST_LINEITEM}
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity,
           strftime(l_shipdate, '%Y-%m-%d') AS ship_day FROM latest
    """,
)
def _latest_version_stored(data):
    """The same from a bucketed table of several loads, one of them merged: no shuffle when it is read."""
    source = data.lineitem_versions()
    path = scratch_path(data.spark, "versions")
    name = f"quarry_versions_{path.rsplit('-', 1)[1]}"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.df.schema)
    stored = VersionedTable(data.spark, name, path, schema, source.keys, source.version, source.tie, 8).bind()
    # Rows of the same day come in the same load, whose ties the columns settle; older days may come later.
    own = F.pmod(F.xxhash64("l_shipdate"), F.lit(3))
    for load in (0, 1):
        stored.append(source.df.filter(own == load), load)
    stored.merge()
    stored.append(source.df.filter(own == 2), 2)
    latest = stored.latest()
    return latest.select(
        "l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "l_quantity", day_text("l_shipdate").alias("ship_day")
    )


@query(
    "latest_version_filtered",
    f"""
    WITH {LATEST_LINEITEM}
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM latest
    WHERE l_quantity > 25 AND l_linenumber >= 2
    """,
)
def _latest_version_filtered(data):
    latest = where(
        data.lineitem_versions().read(),
        [{"column": "l_quantity", "op": ">", "value": 25}, {"column": "l_linenumber", "op": ">=", "value": 2}],
    )
    return latest.select("l_orderkey", F.col("l_linenumber").cast("long"), "l_quantity")


@query(
    "aggregate_latest",
    f"""
    WITH {LATEST_LINEITEM}
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           {sql_round("avg(l_discount)", 6)} AS avg_disc, count(*) AS n
    FROM latest WHERE l_quantity > 5 GROUP BY 1, 2
    """,
)
def aggregate_latest(data):
    result = aggregate(
        data.lineitem_versions(),
        [
            {"func": "sum", "column": "l_quantity", "alias": "sum_qty"},
            {"func": "avg", "column": "l_discount", "alias": "avg_disc"},
            {"func": "count", "alias": "n"},
        ],
        group_by=["l_returnflag", "l_linestatus"],
        filters=[{"column": "l_quantity", "op": ">", "value": 5}],
        order_by=[{"column": "sum_qty", "dir": "desc"}],
    )
    return result.withColumns({"sum_qty": F.round("sum_qty", 2), "avg_disc": F.round("avg_disc", 6)})


@query(
    "aggregate_grouped",
    """
    SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi,
           count(*) AS n, count(l_tax) AS n_tax
    FROM lineitem WHERE l_discount >= 0.02 GROUP BY 1
    """,
)
def _aggregate_grouped(data):
    result = aggregate(
        data.table("lineitem"),
        [
            {"func": "SUM", "column": "l_extendedprice", "alias": "total"},
            {"func": "min", "column": "l_quantity", "alias": "lo"},
            {"func": "max", "column": "l_quantity", "alias": "hi"},
            {"func": "count", "column": "*", "alias": "n"},
            {"func": "count", "column": "l_tax", "alias": "n_tax"},
        ],
        group_by=["l_returnflag"],
        filters=[{"column": "l_discount", "op": ">=", "value": 0.02}],
        order_by=[{"column": "total", "dir": "desc"}],
    )
    return result.withColumn("total", F.round("total", 2))


@query(
    "aggregate_global",
    f"""
    SELECT round(sum(o_totalprice), 2) AS total, {sql_round("avg(o_totalprice)", 4)} AS mean,
           min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders
    """,
)
def _aggregate_global(data):
    measures = [("sum", "total"), ("avg", "mean"), ("min", "lo"), ("max", "hi")]
    result = aggregate(
        data.table("orders"),
        [{"func": f, "column": "o_totalprice", "alias": a} for f, a in measures] + [{"func": "count", "alias": "n"}],
    )
    return result.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query(
    "distinct_values",
    "SELECT DISTINCT p_brand AS value FROM part WHERE p_size > 10",
)
def _distinct_values(data):
    return distinct_values(data.table("part"), "p_brand", [{"column": "p_size", "op": ">", "value": 10}])


@query(
    "select_rows",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice > 100000
    ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 50
    """,
)
def _select_rows(data):
    return select_rows(
        data.table("orders"),
        columns=["o_orderkey", "o_custkey", "o_totalprice"],
        filters=[
            {"column": "o_orderstatus", "value": "F"},
            {"column": "o_totalprice", "op": ">", "value": 100000},
        ],
        order_by=[{"column": "o_totalprice", "dir": "desc"}, {"column": "o_orderkey"}],
        limit=50,
    )


@query(
    "select_rows_all_columns",
    """
    SELECT n_nationkey, n_name, n_regionkey FROM nation
    """,
)
def _select_rows_all(data):
    return select_rows(data.table("nation"), order_by=[{"column": "n_name"}], limit=0)


@query(
    "order_multi",
    """
    SELECT c_custkey, c_mktsegment, CAST(nullif(c_nationkey, 3) AS DOUBLE) AS nation FROM customer
    """,
)
def _order_multi(data):
    customers = data.table("customer").select("c_custkey", "c_mktsegment", F.expr("CAST(nullif(c_nationkey, 3) AS DOUBLE)").alias("nation"))
    return select_rows(
        customers,
        order_by=[
            {"column": "nation", "dir": "desc"},
            {"column": "c_mktsegment", "dir": "asc"},
            {"column": "c_custkey", "dir": "desc"},
        ],
    )


@query("limit_clamp", "SELECT o_orderkey FROM orders")
def _limit_clamp(data):
    return select_rows(data.table("orders"), ["o_orderkey"], order_by=[{"column": "o_orderkey"}], limit="many")


# Filters ----------------------------------------------------------------------
def _filtered(name: str, table: str, columns: str, condition: str, filters: list[dict], source=None) -> None:
    @query(name, f"SELECT {columns} FROM {table} WHERE {condition}")
    def plan(data):
        return where(source(data) if source else data.table(table), filters).select(*[c.strip() for c in columns.split(",")])


_filtered(
    "filter_compare",
    "lineitem",
    "l_orderkey, l_quantity, l_discount",
    "l_quantity >= 10 AND l_quantity < 20 AND l_returnflag <> 'N' AND l_linestatus = 'F' AND l_tax <= 0.06"
    " AND l_discount > 0.01 AND l_partkey <> 7",
    [
        {"column": "l_quantity", "op": ">=", "value": 10},
        {"column": "l_quantity", "op": "<", "value": 20},
        {"column": "l_returnflag", "op": "<>", "value": "N"},
        {"column": "l_linestatus", "op": "==", "value": "F"},
        {"column": "l_tax", "op": "<=", "value": 0.06},
        {"column": "l_discount", "op": ">", "value": 0.01},
        {"column": "l_partkey", "op": "!=", "value": 7},
    ],
)
_filtered(
    "filter_boolean",
    "(SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders) o",
    "o_orderkey",
    "done = true",
    [{"column": "done", "value": True}],
    lambda data: data.table("orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done")),
)


@query("filter_null_literal", "SELECT 'null' AS kind, 0 AS n UNION ALL SELECT 'F', count(*) FROM orders WHERE o_orderstatus = 'F'")
def _filter_null_literal(data):
    """A null literal matches nothing, beside a filter that matches."""
    orders = data.table("orders")
    kinds = ((None, "null"), ("F", "F"))
    parts = [
        where(orders, [{"column": "o_orderstatus", "op": "=", "value": v}]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
        for v, k in kinds
    ]
    return parts[0].unionByName(parts[1])


_filtered(
    "filter_in",
    "orders",
    "o_orderkey, o_orderpriority",
    "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    [{"column": "o_orderpriority", "op": "in", "values": ["1-URGENT", "2-HIGH"]}],
)
_filtered(
    "filter_not_in",
    "orders",
    "o_orderkey, o_orderstatus",
    "o_orderstatus NOT IN ('F', 'P')",
    [{"column": "o_orderstatus", "op": "NOT_IN", "value": ["F", "P"]}],
)
_filtered(
    "filter_like",
    "part",
    "p_partkey, p_name",
    "p_name LIKE '%ring' AND p_name NOT LIKE 's_all%'",
    [
        {"column": "p_name", "op": "LIKE", "value": "%ring"},
        {"column": "p_name", "op": "NOTLIKE", "value": "s_all%"},
    ],
)
_filtered(
    "filter_ilike",
    "part",
    "p_partkey, p_name",
    "p_name ILIKE '%WIDGET%'",
    [{"column": "p_name", "op": "ILIKE", "value": "%WIDGET%"}],
)
_filtered(
    "filter_match",
    "part",
    "p_partkey, p_name",
    "regexp_matches(p_name, '^(red|blue).*t$')",
    [{"column": "p_name", "op": "=~", "value": "^(red|blue).*t$"}],
)
_filtered(
    "filter_not_match",
    "part",
    "p_partkey, p_name",
    "NOT regexp_matches(p_name, 'bolt|ring')",
    [{"column": "p_name", "op": "!~", "value": "bolt|ring"}],
)


@query(
    "stmt_annual",
    f"WITH {STATEMENT} SELECT symbol, year, round(revenue, 2) AS revenue, n_orders FROM stmt WHERE quarter = 0",
)
def _stmt_annual(data):
    return statements.annual(data.statement()).select("symbol", "year", F.round("revenue", 2).alias("revenue"), "n_orders")


@query(
    "stmt_quarterly",
    f"""
    WITH {STATEMENT} SELECT symbol, year, quarter, round(revenue, 2) AS revenue, n_orders FROM stmt WHERE quarter > 0
    """,
)
def _stmt_quarterly(data):
    return statements.quarterly(data.statement()).select(
        "symbol", "year", "quarter", F.round("revenue", 2).alias("revenue"), "n_orders"
    )


# Projections and cleaning --------------------------------------------------------
@query(
    "prj_sanitize",
    """
    SELECT s_name AS Supplier_Name, s_nationkey AS nation_key, s_acctbal AS acct_bal FROM supplier
    """,
)
def _prj_sanitize(data):
    raw = data.table("supplier").toDF("id", " Supplier Name", "nation-key", "acct.bal ")
    return cleaning.sanitize_columns(raw).drop("id")


@query(
    "prj_headers",
    "SELECT s_suppkey AS sub_id, s_name AS organ_name, s_acctbal AS ownership_pct, CAST(s_nationkey AS BIGINT) AS x_y_z FROM supplier",
)
def _prj_headers(data):
    raw = data.table("supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("long"))
    raw = raw.select("s_suppkey", "s_name", "s_acctbal", "s_nationkey").toDF(" Sub-ID", "Organ.Name", "(Ownership)_%", "X y-z")
    return raw.toDF(*map(cleaning.header_name, raw.columns))


@query(
    "prj_shape",
    """
    SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'UNKNOWN') AS symbol, CAST(c_custkey AS DOUBLE) AS dps,
           strftime(DATE '2020-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') AS record_date, 'UNKNOWN' AS market
    FROM customer
    """,
)
def _prj_shape(data):
    """Aliased, repeated and unknown headers; a missing column that must not be null."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int"))
    raw = data.table("customer").select(
        F.expr("nullif(c_mktsegment, 'BUILDING')"), "c_name", F.format_number("c_custkey", 0), F.date_format(day, "dd/MM/yyyy"), "c_acctbal"
    ).toDF("Ticker", "SYMBOL", "Dividend per Share", "Ex-Date", "Other")
    schema = {
        "symbol": cleaning.Field("string", nullable=False, fallback="UNKNOWN"),
        "dps": cleaning.Field("double"),
        "record_date": cleaning.Field("date"),
        "market": cleaning.Field("string", nullable=False, fallback="UNKNOWN"),
    }
    aliases = {"ticker": "symbol", "dividend_per_share": "dps", "ex_date": "record_date"}
    return cleaning.shape_to_schema(raw, schema, aliases).withColumn("record_date", day_text("record_date"))


_DATE_TEXTS = """
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'n/a' END
"""


def _date_texts():
    day = F.col("o_orderdate")
    texts = [F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy")]
    return F.get(F.array(*texts, F.lit("n/a")), (F.col("o_orderkey") % 5).cast("int"))


@query(
    "cast_dates",
    f"""
    WITH raw AS (SELECT o_orderkey, {_DATE_TEXTS} AS t FROM orders)
    SELECT o_orderkey, strftime(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y'),
             try_strptime(t, '%d-%m-%Y'), try_strptime(t, '%m/%d/%Y')), '%Y-%m-%d') AS day
    FROM raw
    """,
)
def _cast_dates(data):
    raw = data.table("orders").select("o_orderkey", _date_texts().alias("t"))
    return raw.select("o_orderkey", day_text(cleaning.first_date(F.col("t"))).alias("day"))


@query(
    "cast_numbers",
    """
    WITH raw AS (
      SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a'
             ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) END AS t FROM orders)
    SELECT o_orderkey, TRY_CAST(replace(t, ',', '') AS DOUBLE) AS as_double,
           CAST(TRY_CAST(replace(t, ',', '') AS BIGINT) AS DOUBLE) AS as_long FROM raw
    """,
)
def _cast_numbers(data):
    shown = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    raw = data.table("orders").select("o_orderkey", shown.alias("t"))
    return raw.select(
        "o_orderkey",
        cleaning.number(F.col("t"), "double").alias("as_double"),
        cleaning.number(F.col("t"), "long").cast("double").alias("as_long"),
    )


@query(
    "cast_datetimes",
    """
    WITH raw AS (
      SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
             WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE 'soon' END AS t FROM events)
    SELECT event_id,
      strftime(coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y-%m-%d'),
               TIMESTAMP '1970-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS created_at,
      strftime(coalesce(try_strptime(t, '%Y-%m-%d'), TIMESTAMP '1970-01-01 00:00:00'), '%Y-%m-%d') AS day
    FROM raw
    """,
)
def _cast_datetimes(data):
    texts = F.array(time_text("ts"), day_text("ts"), F.lit("soon"))
    raw = data.table("events").select("event_id", F.get(texts, (F.col("event_id") % 3).cast("int")).alias("created_at"))
    both = raw.withColumn("day", F.col("created_at"))
    cast = cleaning.cast_date_columns(both, {"created_at": "datetime", "day": "date", "event_id": "date", "gone": "date"})
    return cast.select("event_id", time_text("created_at").alias("created_at"), day_text("day").alias("day"))


@query(
    "prj_fallbacks",
    """
    SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#2'), 'UNKNOWN') AS symbol, 'UNKNOWN' AS market FROM part
    """,
)
def _prj_fallbacks(data):
    symbol = cleaning.Field("string", nullable=False, fallback="UNKNOWN")
    brand = F.expr("nullif(p_brand, 'Brand#2')")
    return data.table("part").select(
        "p_partkey", cleaning.convert(brand, symbol).alias("symbol"), cleaning.missing("market", symbol).alias("market")
    )


@query(
    "prj_defaults",
    """
    SELECT o_orderkey, coalesce(nullif(CAST(quarter(o_orderdate) AS BIGINT), 4), 0) AS quarter FROM orders
    """,
)
def _prj_defaults(data):
    nullable = data.table("orders").select(
        "o_orderkey", F.expr("nullif(CAST(quarter(o_orderdate) AS BIGINT), 4L)").alias("quarter")
    )
    return cleaning.fill_defaults(nullable, {"quarter": 0, "absent": 0})


@query(
    "prj_truncate",
    """
    SELECT doc_id, lang || '_' || source AS file_name, substring(text, 1, 8000) AS chunk_text,
           substring(text, 1, 2000) AS rerank_text, substring(text, 1, 300) AS preview FROM documents
    """,
)
def _prj_truncate(data):
    cuts = {"chunk_text": 8000, "rerank_text": 2000, "preview": 300}
    return data.table("documents").select(
        "doc_id",
        F.concat_ws("_", "lang", "source").alias("file_name"),
        *[F.substring("text", 1, n).alias(name) for name, n in cuts.items()],
    )


@query(
    "chart_series",
    """
    WITH y AS (
      SELECT CAST(year(o_orderdate) AS VARCHAR) AS x, o_orderstatus, sum(o_totalprice) AS total,
             CASE WHEN year(o_orderdate) = 1997 THEN NULL ELSE round(sum(o_totalprice), 2) END AS y1,
             CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS y2
      FROM orders GROUP BY year(o_orderdate), o_orderstatus)
    SELECT x, o_orderstatus, y1, y2 FROM y WHERE coalesce(y1, y2) IS NOT NULL
    """,
)
def _chart_series(data):
    year = F.year("o_orderdate")
    grouped = data.table("orders").groupBy(year.alias("year"), "o_orderstatus").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n")
    )
    raw = grouped.select(
        F.col("year").alias("x"),
        "o_orderstatus",
        F.when(F.col("year") != 1997, F.col("total").cast("string")).otherwise("none").alias("y1"),
        F.when(F.col("o_orderstatus") != "P", F.col("n").cast("string")).alias("y2"),
    )
    return statements.chart_series(raw, "x", ["y1", "y2"])


# Set operations -------------------------------------------------------------------
@query(
    "union_master_wins",
    """
    SELECT c_custkey AS id, 'master' AS origin FROM customer
    UNION ALL
    SELECT k, 'extra' FROM (SELECT DISTINCT o_custkey + 700 AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)
    """,
)
def _union_master_wins(data):
    master = data.table("customer").select(F.col("c_custkey").alias("id"), F.lit("master").alias("origin"))
    extra = data.table("orders").select((F.col("o_custkey") + 700).alias("id")).distinct().withColumn("origin", F.lit("extra"))
    return evaluation.union_keep_first(master, extra, ["id"])


@query(
    "jaccard",
    f"""
    WITH w AS (
      SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: len(x) > 0)) AS ws
      FROM conversations)
    SELECT a.conv_id, a.turn, CASE WHEN len(list_distinct(list_concat(a.ws, b.ws))) = 0 THEN 1.0
           ELSE {sql_round("len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))", 6)} END AS score
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
    """,
)
def _jaccard(data):
    """Word overlap of every message with the next one of its conversation."""
    said = data.table("conversations").select("conv_id", "turn", F.split(F.lower("text"), r"\s+").alias("ws"))
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("next_ws"))
    pairs = said.join(after, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(arrays.jaccard(F.col("ws"), F.col("next_ws")), 6).alias("score"))


@query(
    "dedupe_list",
    """
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: len(x) > 0) AS ws FROM documents),
    e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
    f AS (SELECT doc_id, lower(word) AS k, min(pos) AS pos, arg_min(word, pos) AS word FROM e GROUP BY 1, 2)
    SELECT doc_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY pos)) AS words_md5 FROM f GROUP BY 1
    """,
)
def _dedupe_list(data):
    """Words of a text without repeats; the first spelling of each is kept.

    A document with one row is done inside that row; only the words of documents with several rows are shuffled.
    """
    texts = data.table("documents").select("doc_id", "text")
    several = texts.groupBy(F.col("doc_id").alias("own")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    same = F.col("doc_id").eqNullSafe(F.col("own"))
    split = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 0)
    alone = spread(texts).join(several, same, "left_anti").select("doc_id", arrays.first_spellings(split).alias("first")).filter(F.size("first") > 0)
    words = texts.join(several, same, "left_semi").select("doc_id", F.posexplode(split).alias("pos", "word"))
    first = words.groupBy("doc_id", F.lower("word").alias("k")).agg(F.min(F.struct("pos", "word")).alias("first"))
    # Bounded by the distinct words of one text.
    kept = first.groupBy("doc_id").agg(F.array_sort(F.collect_list("first")).alias("first"))
    kept = alone.unionByName(kept.withColumn("first", F.transform("first", lambda e: e["word"])))
    joined = F.array_join("first", " ")
    return kept.select("doc_id", F.size("first").cast("long").alias("n"), F.md5(joined).alias("words_md5"))


# Ratios and dates -------------------------------------------------------------------
@query(
    "safe_ratios",
    f"""
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey,
      {sql_round("l_extendedprice / nullif(l_discount, 0) * 100", 2)} AS price_to_discount,
      {sql_round("l_tax / nullif(l_discount, 0)", 2)} AS tax_to_discount
    FROM lineitem
    """,
)
def _safe_ratios(data):
    return data.table("lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("line"),
        "l_partkey",
        statements.ratio(F.col("l_extendedprice"), F.col("l_discount"), 100).alias("price_to_discount"),
        statements.ratio(F.col("l_tax"), F.col("l_discount")).alias("tax_to_discount"),
    )


@query(
    "fiscal_context",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
      CAST(CASE WHEN quarter(o_orderdate) = 1 THEN 4 ELSE quarter(o_orderdate) - 1 END AS BIGINT) AS last_quarter,
      CAST(CASE WHEN quarter(o_orderdate) = 1 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS BIGINT) AS last_quarter_year,
      CAST(CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) - 2 END AS BIGINT) AS last_full_year
    FROM orders
    """,
)
def _fiscal_context(data):
    parts = dates.fiscal_context(F.col("o_orderdate").cast("date"))
    return data.table("orders").select("o_orderkey", *[c.alias(name) for name, c in parts.items()])


@query(
    "epoch_ms",
    """
    SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
    FROM events WHERE epoch_us(ts) // 1000 >= epoch_ms(TIMESTAMP '2024-01-10 00:00:00')
    """,
)
def _epoch_ms(data):
    ms = dates.to_epoch_ms(F.col("ts"))
    rows = data.table("events").select("event_id", ms.alias("ms"))
    since = dates.to_epoch_ms(F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return rows.filter(F.col("ms") >= since).withColumn("at", time_text(dates.from_epoch_ms(F.col("ms"))))


@query(
    "best_effort_date",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL
      ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders
    """,
)
def _best_effort_date(data):
    layouts = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")
    shown = F.array(*[F.date_format("o_orderdate", f) for f in layouts], F.lit("unknown"))
    raw = data.table("orders").select("o_orderkey", F.get(shown, (F.col("o_orderkey") % 6).cast("int")).alias("t"))
    return raw.select("o_orderkey", time_text(dates.loose_timestamp(F.col("t"))).alias("parsed"))


@query(
    "age_buckets",
    """
    WITH d AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN DATE '2001-08-01'
             ELSE CAST(o_orderdate AS DATE) END AS day FROM orders)
    SELECT CASE WHEN day = DATE '2001-08-01' THEN 'Today' WHEN day = DATE '2001-07-31' THEN 'Yesterday'
                WHEN day >= DATE '2001-07-25' THEN 'Last 7 days' ELSE 'Older' END AS bucket, count(*) AS n
    FROM d GROUP BY 1
    """,
)
def _age_buckets(data):
    shown = F.when(F.col("o_orderkey") % 50 == 0, "broken").otherwise(day_text("o_orderdate"))
    day = F.try_to_date(shown, "yyyy-MM-dd")
    bucket = dates.age_bucket(day, F.lit("2001-08-01").cast("date"))
    return data.table("orders").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "unit_scale",
    f"""
    SELECT o_orderkey, {sql_round("o_totalprice * 100000 / 1e9", 1)} AS billions,
           {sql_round("o_totalprice / 1000000 * 100", 2)} AS pct FROM orders
    """,
)
def _unit_scale(data):
    price = F.col("o_totalprice")
    return data.table("orders").select(
        "o_orderkey",
        statements.to_billions(price * 100000).alias("billions"),
        statements.to_percent(price / 1000000).alias("pct"),
    )


@query(
    "pct_pick",
    """
    WITH r AS (
      SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
             count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, value FROM r WHERE pos = floor(0.92 * (n - 1))
    """,
)
def _pct_pick(data):
    """92nd percentile by nearest rank."""
    return nearest_rank(data.table("events"), ["event_type"], "value", 0.92)


@query(
    "vector_distance",
    f"""
    WITH d AS (
      SELECT a.vec_id, list_sum(list_transform(generate_series(1, len(a.embedding)),
               lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) AS dot
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, {sql_round("1 - dot", 6)} AS distance FROM d
    """,
)
def _vector_distance(data):
    """Cosine distance of every vector to its successor."""
    vectors = data.table("embeddings").select("vec_id", "embedding")
    successor = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = vectors.join(successor, "vec_id")
    return pairs.select("vec_id", F.round(numeric.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


# Names, paths, tokens -----------------------------------------------------------------
@query(
    "name_search",
    """
    SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('BoLt')) OR contains(lower(p_type), lower('econ'))
    """,
)
def _name_search(data):
    hit = text.contains_ignore_case(F.col("p_name"), F.lit("BoLt")) | text.contains_ignore_case(F.col("p_type"), F.lit("econ"))
    return data.table("part").filter(hit).select("p_partkey", "p_name")


@query(
    "hashes",
    "SELECT doc_id, md5(text) AS chunk_hash, sha256(text) AS file_hash FROM documents",
)
def _hashes(data):
    return data.table("documents").select("doc_id", text.chunk_hash(F.col("text")).alias("chunk_hash"), text.file_hash(F.col("text")).alias("file_hash"))


@query(
    "sentences",
    """
    WITH s AS (
      SELECT doc_id, list_filter(list_transform(
        string_split(regexp_replace(regexp_replace(trim(text, E' \\n'), '([.!?;])\\s+', '\\1\x01', 'g'), '\\n{2,}', '\x01', 'g'), '\x01'),
        lambda x: trim(x, E' \\n')), lambda x: length(x) > 0) AS parts FROM documents)
    SELECT doc_id, CAST(len(parts) AS BIGINT) AS n, md5(array_to_string(parts, '|')) AS parts_md5 FROM s
    """,
)
def _sentences(data):
    parts = data.table("documents").select("doc_id", text.sentences(F.col("text")).alias("parts"))
    return parts.select("doc_id", F.size("parts").cast("long").alias("n"), F.md5(F.array_join("parts", "|")).alias("parts_md5"))


@query(
    "test_token",
    """
    WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ' [ b-' || CAST(conv_id AS VARCHAR) || ' ]  ' || text
                 ELSE text END AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'B-' || CAST(conv_id AS VARCHAR) END AS test_id,
           md5(CASE WHEN turn % 2 = 0 THEN trim(regexp_replace(t, '^ \\[ b-\\d+ \\]', ''), E' \\n') ELSE t END) AS rest_md5
    FROM m
    """,
)
def _test_token(data):
    token = F.concat(F.lit(" [ b-"), F.col("conv_id").cast("string"), F.lit(" ]  "), F.col("text"))
    message = F.when(F.col("turn") % 2 == 0, token).otherwise(F.col("text"))
    raw = data.table("conversations").select("conv_id", "turn", message.alias("t"))
    return raw.select(
        "conv_id", "turn", text.test_id(F.col("t")).alias("test_id"), F.md5(text.test_text(F.col("t"))).alias("rest_md5")
    )


@query(
    "category_prefix",
    """
    WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'B. ' || source WHEN 1 THEN ' c ' || lang WHEN 2 THEN '' ELSE NULL END AS c
               FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'B.' WHEN 1 THEN 'c.' ELSE '' END AS prefix,
           CASE doc_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE '?' END AS bucket FROM c
    """,
)
def _category_prefix(data):
    kinds = F.array(F.concat(F.lit("B. "), "source"), F.concat(F.lit(" c "), "lang"), F.lit(""), F.lit(None))
    raw = data.table("documents").select("doc_id", F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("c"))
    return raw.select("doc_id", text.category_prefix(F.col("c")).alias("prefix"), text.bucket(F.col("c")).alias("bucket"))


@query(
    "url_host",
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_matches(url, '^https?://') AS is_web FROM pages",
)
def _url_host(data):
    return data.table("pages").select("page_id", text.url_host(F.col("url")).alias("host"), text.is_web_url(F.col("url")).alias("is_web"))


@query(
    "object_path",
    f"""
    WITH {FILES}, f AS (SELECT *, project_id - 5 AS project, replace(file_name, '_', '/') AS raw_name,
           CASE WHEN file_id % 2 = 0 THEN 's' || CAST(file_id AS VARCHAR) END AS session_id FROM files)
    SELECT file_id, CASE
      WHEN project < 0 THEN 'incognito/' || coalesce(session_id, 'no_session') || '/' || file_hash || '_' || replace(raw_name, '/', '_')
      WHEN project = 0 THEN 'base/user_' || CAST(user_id AS VARCHAR) || '/' || file_hash || '_' || replace(raw_name, '/', '_')
      ELSE 'user_' || CAST(user_id AS VARCHAR) || '/project_' || CAST(project AS VARCHAR) || '/' || file_hash || '_' || replace(raw_name, '/', '_')
      END AS path FROM f
    """,
)
def _object_path(data):
    files = data.files().withColumn("project", F.col("project_id") - 5)
    session = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("s"), F.col("file_id").cast("string")))
    raw_name = F.translate("file_name", "_", "/")
    path = text.object_path(F.col("project"), F.col("user_id"), session, F.col("file_hash"), raw_name)
    return files.select("file_id", path.alias("path"))


@query(
    "clean_entities",
    """
    WITH w AS (SELECT conv_id, turn, list_concat(regexp_split_to_array(text, '\\s+'), ['', 'a<b', 'ACME & Co.', 'acme & co.']) AS ws
               FROM conversations),
    e AS (SELECT conv_id, turn, unnest(ws) AS m, generate_subscripts(ws, 1) AS pos FROM w),
    f AS (SELECT conv_id, turn, lower(m) AS k, min(pos) AS pos, arg_min(m, pos) AS m FROM e
          WHERE length(m) > 0 AND regexp_full_match(m, '[\\p{L}\\p{N}_ \\-.&,/]+') GROUP BY 1, 2, 3),
    g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rn FROM f)
    SELECT conv_id, turn, string_agg(m, '|' ORDER BY pos) AS entities FROM g GROUP BY 1, 2
    """,
)
def _clean_entities(data):
    noise = F.array(*[F.lit(x) for x in ("", "a<b", "ACME & Co.", "acme & co.")])
    mentions = F.concat(F.split("text", r"\s+"), noise)
    return data.table("conversations").select(
        "conv_id", "turn", F.array_join(text.clean_entities(mentions), "|").alias("entities")
    )


@query(
    "norm_prefixes",
    """
    WITH p AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || '_' AS a,
                      CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) || '_' ELSE 'X1_' END AS b FROM part)
    SELECT p_partkey, a || '|' || repeat('Z', 40) || '_' || CASE WHEN a = b THEN '' ELSE '|' || b END AS prefixes FROM p
    """,
)
def _norm_prefixes(data):
    word = F.substring_index("p_name", " ", 1)
    second = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise("x1_")
    raw = F.array(word, F.lit("a-b"), F.lit(""), F.concat(F.lit(" "), F.upper(word), F.lit("_")), F.lit("z" * 40), second)
    return data.table("part").select("p_partkey", F.array_join(text.normalize_prefixes(raw), "|").alias("prefixes"))


@query(
    "coerce_list",
    """
    WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, E' \\n')), lambda x: length(x) > 0) AS xs
               FROM documents)
    SELECT doc_id, CAST(len(xs) AS BIGINT) AS n, md5(array_to_string(xs, '|')) AS items_md5 FROM w
    """,
)
def _coerce_list(data):
    rows = data.table("documents").select("doc_id", text.coerce_comma_list(F.col("text")).alias("xs"))
    return rows.select("doc_id", F.size("xs").cast("long").alias("n"), F.md5(F.array_join("xs", "|")).alias("items_md5"))


@query(
    "extract_json",
    """
    SELECT event_id, CAST(CASE WHEN event_id % 5 = 4 THEN NULL ELSE props ->> 'k' END AS DOUBLE) AS k FROM events
    """,
)
def _extract_json(data):
    props = F.col("props")
    shapes = F.array(
        props,
        F.concat(F.lit("```json\n"), props, F.lit("\n```")),
        F.concat(F.lit("Sure, here it is:\n```\n"), props, F.lit("\n```\nDone.")),
        F.concat(F.lit("The answer is "), props, F.lit(" as asked.")),
        F.lit("no object { here"),
    )
    raw = data.table("events").select("event_id", F.get(shapes, (F.col("event_id") % 5).cast("int")).alias("reply"))
    return raw.select("event_id", F.get_json_object(text.loose_json(F.col("reply")), "$.k").cast("double").alias("k"))


@query("json_field", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def _json_field(data):
    return data.table("events").select("event_id", text.json_field(F.col("props"), "k").cast("long").alias("k"))


@query(
    "top_children",
    """
    SELECT l_orderkey, l_partkey, l_extendedprice, rn AS child_no FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_shipdate) AS rn
      FROM lineitem) WHERE rn <= 3
    """,
)
def _top_children(data):
    top = statements.top_children(
        data.table("lineitem"), "l_orderkey", "l_extendedprice", ["l_partkey", "l_linenumber", "l_shipdate"], 3
    )
    return top.select("l_orderkey", "l_partkey", "l_extendedprice", "child_no")
