"""Warehouse sinks: append, month partitions, component logs, load audit."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.functions.dates import month_key
from quarry.operators.cleaning import cast_date_columns, fill_defaults, sanitize_columns

log = logging.getLogger(__name__)

MONTH = "yyyymm"
# Loads that run at the same time.
PARALLEL_LOADS = 4

AUDIT_SCHEMA = (
    "manifest_name STRING, table_name STRING, source_file STRING, file_type STRING, "
    "row_count BIGINT, file_size BIGINT, ingested_at TIMESTAMP, spark_job_id STRING, status STRING"
)
AUDIT_STATES = ("success", "failed")

_STATEMENT = {"created_at": "datetime", "updated_at": "datetime"}
_CREATED = {"created_at": "datetime"}

# Warehouse tables, their text dates, defaults and load options.
DATE_COLUMNS: dict[str, dict[str, str]] = {
    "stocks": _STATEMENT,
    "exchanges": _CREATED,
    "indices": _CREATED,
    "industries": _CREATED,
    "company_overview": _STATEMENT,
    "balance_sheet": _STATEMENT,
    "cash_flow_statement": _STATEMENT,
    "income_statement": _STATEMENT,
    "financial_ratios": _STATEMENT,
    "financial_reports": _STATEMENT,
    "events": _CREATED,
    "news": _CREATED,
    "officers": _CREATED,
    "shareholders": _CREATED,
    "subsidiaries": _CREATED,
    "stock_price_history": {"time": "date", "created_at": "datetime"},
    "stock_intraday": {"time": "datetime"},
    "update_log": {"update_time": "datetime"},
    "stock_exchange": {},
    "stock_index": {},
    "stock_industry": {},
}
KNOWN_TABLES = frozenset(DATE_COLUMNS)
STATEMENT_TABLES = ("balance_sheet", "cash_flow_statement", "income_statement", "financial_ratios", "financial_reports")
COLUMN_DEFAULTS = {table: {"quarter": 0} for table in STATEMENT_TABLES}
SURROGATE_ID_TABLES = frozenset(
    ("stocks", "exchanges", "indices", "industries", "stock_exchange", "stock_index", "stock_industry", "company_overview")
)
RANGE_READ_COLUMN = {table: "id" for table in (*STATEMENT_TABLES, "stock_price_history")}
RANGE_READ_PARTS = 8
TIME_COLUMN = {"stock_price_history": "time", "stock_intraday": "time"}


def clean_warehouse_rows(df: DataFrame, table: str) -> DataFrame:
    """Names, text dates, defaults and surrogate ids of one warehouse table."""
    df = cast_date_columns(sanitize_columns(df), DATE_COLUMNS.get(table, {}))
    df = fill_defaults(df, COLUMN_DEFAULTS.get(table, {}))
    return df.drop("id") if table in SURROGATE_ID_TABLES else df


def with_month(df: DataFrame, time: str) -> DataFrame:
    """Add the month partition key of a time column."""
    return df.withColumn(MONTH, month_key(F.col(time)))


def in_months(df: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    """Rows in `[start, end)`, with the matching predicate on the month folders."""
    months = (F.col(MONTH) >= month_key(start)) & (F.col(MONTH) <= month_key(end))
    return df.filter(months & (F.col(time) >= start) & (F.col(time) < end))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_once(df: DataFrame, path: str, source_file: str, batch: str) -> None:
    """Append the rows of one source file and batch; loading the same again replaces them.

    Each load has a folder of its own, named by `load`, a partition column of the table.
    """
    name = hashlib.sha256(f"{source_file}\n{batch}".encode()).hexdigest()[:16]
    rows = df.withColumns({"source_file": F.lit(source_file), "batch": F.lit(batch)})
    rows.write.mode("overwrite").parquet(f"{path}/load={name}")


def append_by_month(df: DataFrame, path: str, time: str, cluster: Sequence[str] = ("symbol",), tasks: int | None = None) -> None:
    """Append to month folders, sorted inside the files.

    Rows are range-partitioned by month, cluster columns and time: a month that
    holds much of the data spans several tasks, and a task writes few folders.
    """
    keyed = with_month(df, time)
    keys = [MONTH, *cluster, time]
    parts = (tasks, *keys) if tasks else keys
    spread = keyed.repartitionByRange(*parts)
    spread.sortWithinPartitions(*keys).write.partitionBy(MONTH).mode("append").parquet(path)


def append_component_logs(df: DataFrame, path: str) -> None:
    """JSON lines per component; records without one go to `unknown`."""
    component = F.when(F.coalesce("component", F.lit("")) == "", "unknown").otherwise(F.col("component"))
    df.withColumn("component", component).write.partitionBy("component").mode("append").json(path)


@dataclass(frozen=True)
class Load:
    """One table of one source file to be loaded."""

    manifest: str
    table: str
    source_file: str
    file_type: str
    file_size: int
    read: Callable[[], DataFrame]


def load_tables(
    spark: SparkSession, loads: Iterable[Load], write: Callable[[DataFrame, str], None], known: Mapping | frozenset = KNOWN_TABLES
) -> DataFrame:
    """Run every load and return the audit rows.

    Unknown tables are skipped. A load that fails is recorded and does not stop
    the others. Rows are counted while they are written, not by a second job. Several
    loads run at a time, so that small tables do not wait for large ones.
    """

    def run(load: Load) -> tuple | None:
        if load.table not in known:
            log.warning("table %s is not known, skipped", load.table)
            return None
        count, status = 0, "success"
        try:
            seen = Observation()
            write(load.read().observe(seen, F.count(F.lit(1)).alias("rows")), load.table)
            count = int(seen.get["rows"])
        except Exception:
            log.exception("loading %s from %s failed", load.table, load.source_file)
            status = "failed"
        return (
            load.manifest, load.table, load.source_file, load.file_type, count, load.file_size,
            None, spark.sparkContext.applicationId, status,
        )

    with ThreadPool(PARALLEL_LOADS) as pool:
        rows = [row for row in pool.map(inheritable_thread_target(spark)(run), list(loads)) if row]
    audit = spark.createDataFrame(rows, AUDIT_SCHEMA)
    return audit.withColumn("ingested_at", F.current_timestamp())


def write_audit(audit: DataFrame, path: str) -> bool:
    """Append audit rows; a failure is reported but never raised."""
    try:
        audit.coalesce(1).write.mode("append").parquet(path)
    except Exception:
        log.exception("writing the load audit to %s failed", path)
        return False
    return True
