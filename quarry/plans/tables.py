"""Input tables, and the views that give them the shapes the operators expect.

Every view exists twice: as a DataFrame method of `Data` and as the SQL text of
a common table expression, so that a plan and its oracle start from the same
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, market, statements
from quarry.operators.versions import Table
from quarry.session import spread

FILE_STATES = ("ready", "failed", "pending", "processing", "deleted")
FILE_TYPES = ("txt", "md", "pdf", "docx", "csv", "xlsx")


def day_text(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def time_text(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def pick(values: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def sql_pick(values: tuple[str, ...], position: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{position} + 1]"


def _decimal(value: str) -> str:
    # Through the shortest text of a double, which is what Spark rounds.
    return f"CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,16))"


def sql_round(value: str, digits: int) -> str:
    """Round half up on the decimal form, as Spark's `round` does."""
    return f"CAST(round({_decimal(value)}, {digits}) AS DOUBLE)"


def sql_bround(value: str, digits: int) -> str:
    """Round half to even on the decimal form, as Spark's `bround` does."""
    shifted = f"({_decimal(value)} * {10**digits})"
    return (
        f"CAST(CASE WHEN abs({shifted} - trunc({shifted})) = 0.5 AND trunc({shifted}) % 2 = 0"
        f" THEN trunc({shifted}) ELSE round({shifted}, 0) END AS DOUBLE) / {10**digits}"
    )


TICKS = """
ticks AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, ts AS time, value AS price,
         event_id % 100 + 1 AS volume, event_type AS match_type, event_id AS seq
  FROM events)
"""

# The same over four months.
MONTH_TICKS = f"""{TICKS}, month_ticks AS (
  SELECT * REPLACE (time + to_months(CAST(seq % 4 AS INTEGER)) AS time) FROM ticks)
"""

BARS = f"""{TICKS}, bars AS (
  SELECT symbol, date_trunc('day', time) AS time, arg_min(price, time) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, time) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM ticks GROUP BY 1, 2)
"""

STATEMENT = """
quarters AS (
  SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol, CAST(year(o_orderdate) AS BIGINT) AS year,
         CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
         sum(o_totalprice) AS revenue, CAST(count(*) AS BIGINT) AS n_orders
  FROM orders GROUP BY 1, 2, 3),
stmt AS (
  SELECT * FROM quarters
  UNION ALL
  SELECT symbol, year, 0, sum(revenue), CAST(sum(n_orders) AS BIGINT) FROM quarters GROUP BY 1, 2)
"""

CASHFLOW = """
cashflow AS (
  SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol, CAST(year(o_orderdate) AS BIGINT) AS year,
         round(sum(l_extendedprice), 2) AS operating, 0 - round(sum(l_extendedprice * l_discount), 4) AS capex,
         round(sum(l_extendedprice * l_tax), 4) AS tax, round(sum(l_quantity), 2) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
"""

FILES = f"""
files AS (
  SELECT doc_id AS file_id, doc_id % 7 AS user_id, CAST(substr(source, 4) AS BIGINT) AS project_id,
         sha256(text) AS file_hash,
         upper(lang) || '_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name,
         {sql_pick(FILE_TYPES, "doc_id % 6")} AS file_type,
         {sql_pick(FILE_STATES, "doc_id % 5")} AS process_status,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS process_at,
         text
  FROM documents)
"""

CHAT = """
chat AS (SELECT conv_id AS session_id, turn AS num_order, role, text FROM conversations)
"""

LOGS = """
logs AS (
  SELECT role AS component, 'T' || CAST(conv_id AS VARCHAR) AS test_id,
         substr('ABCDEFGHI', CAST(conv_id % 9 AS INTEGER) + 1, 1) || '.' AS category, turn AS line,
         CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) // 3 END AS input_tokens,
         CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) - length(text) // 3 END AS output_tokens,
         CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) END AS total_tokens
  FROM conversations)
"""

CASES = """
cases AS (
  SELECT 'D' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, doc_id AS seq,
         substr('ABCDEFGHI', CAST(doc_id % 9 AS INTEGER) + 1, 1) || '. case' AS category,
         lang AS persona, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS reference_answer
  FROM documents)
"""


class Data:
    """The tables below one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # market --------------------------------------------------------------
    def ticks(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
            F.col("ts").alias("time"),
            F.col("value").alias("price"),
            (F.col("event_id") % 100 + 1).alias("volume"),
            F.col("event_type").alias("match_type"),
            F.col("event_id").alias("seq"),
        )

    def month_ticks(self) -> DataFrame:
        later = F.make_ym_interval(F.lit(0), (F.col("seq") % 4).cast("int"))
        return self.ticks().withColumn("time", F.col("time") + later)

    def bars(self) -> DataFrame:
        return market.bars(self.ticks(), "day")

    # statements ------------------------------------------------------------
    def quarters(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy(
                F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
                F.year("o_orderdate").cast("long").alias("year"),
                F.quarter("o_orderdate").cast("long").alias("quarter"),
            )
            .agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n_orders"))
        )

    def statement(self) -> DataFrame:
        return statements.with_annual_rows(self.quarters(), ["revenue", "n_orders"])

    def cashflow(self) -> DataFrame:
        """Yearly sums per customer; order lines are summed per order before the join."""
        price = F.col("l_extendedprice")
        lines = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.sum(price).alias("operating"),
                F.sum(price * F.col("l_discount")).alias("spent"),
                F.sum(price * F.col("l_tax")).alias("tax"),
                F.sum("l_quantity").alias("quantity"),
            )
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
            F.year("o_orderdate").cast("long").alias("year"),
        )
        return (
            lines.join(orders, "l_orderkey")
            .groupBy("symbol", "year")
            .agg(
                F.round(F.sum("operating"), 2).alias("operating"),
                (F.lit(0.0) - F.round(F.sum("spent"), 4)).alias("capex"),
                F.round(F.sum("tax"), 4).alias("tax"),
                F.round(F.sum("quantity"), 2).alias("quantity"),
            )
        )

    def lineitem_versions(self) -> Table:
        return Table(
            self.table("lineitem"),
            keys=("l_orderkey", "l_linenumber"),
            version="l_shipdate",
            tie=("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"),
        )

    # corpus ------------------------------------------------------------------
    def files(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.table("documents").select(
            doc.alias("file_id"),
            (doc % 7).alias("user_id"),
            F.expr("CAST(substr(source, 4) AS BIGINT)").alias("project_id"),
            F.sha2("text", 256).alias("file_hash"),
            F.concat(F.upper("lang"), F.lit("_"), doc.cast("string"), F.lit(".txt")).alias("file_name"),
            pick(FILE_TYPES, doc % 6).alias("file_type"),
            pick(FILE_STATES, doc % 5).alias("process_status"),
            F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)").alias("process_at"),
            F.col("text"),
        )

    def chunks(self) -> DataFrame:
        """Rule-based chunks of all documents with the columns of a collection."""
        files = self.files().select("file_id", "project_id", "file_name", "text")
        return chunking.chunk_documents(spread(files), keep=["file_id", "project_id", "file_name"])

    # conversations ---------------------------------------------------------------
    def chat(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("session_id"), F.col("turn").alias("num_order"), "role", "text"
        )

    def logs(self) -> DataFrame:
        size = F.length("text").cast("long")
        used = F.col("turn") % 5 != 4
        third = F.floor(size / 3)
        return self.table("conversations").select(
            F.col("role").alias("component"),
            F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("test_id"),
            F.concat(pick(tuple("ABCDEFGHI"), F.col("conv_id") % 9), F.lit(".")).alias("category"),
            F.col("turn").alias("line"),
            F.when(used, third).alias("input_tokens"),
            F.when(used, size - third).alias("output_tokens"),
            F.when(used, size).alias("total_tokens"),
        )

    # evaluation --------------------------------------------------------------------
    def cases(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.table("documents").select(
            F.concat(F.lit("D"), F.lpad(doc.cast("string"), 9, "0")).alias("id"),
            doc.alias("seq"),
            F.concat(pick(tuple("ABCDEFGHI"), doc % 9), F.lit(". case")).alias("category"),
            F.col("lang").alias("persona"),
            F.when(doc % 4 != 0, F.col("text")).alias("reference_answer"),
        )
