"""SQLite tables as a Spark data source, read in id ranges.

The file must be reachable from every executor under the same path. It is only
ever opened read-only. Columns declared as dates or times arrive as text.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "sqlite_table"

_CONVERT = {T.LongType(): int, T.DoubleType(): float, T.StringType(): str, T.BinaryType(): bytes}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def list_tables(path: str) -> list[str]:
    """User tables of a file, by name."""
    sql = "SELECT name FROM sqlite_master WHERE type = 'table' AND substr(name, 1, 7) <> 'sqlite_' ORDER BY name"
    with _open(path) as db:
        return [name for (name,) in db.execute(sql)]


def spark_type(declared: str) -> T.DataType:
    """Spark type for a declared SQLite type."""
    declared = declared.upper()
    if "DATE" in declared or "TIME" in declared:
        return T.StringType()
    if "INT" in declared:
        return T.LongType()
    if any(word in declared for word in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in declared else T.StringType()


def table_schema(path: str, table: str) -> T.StructType:
    with _open(path) as db:
        columns = db.execute(f"PRAGMA table_info({_name(table)})").fetchall()
    if not columns:
        raise ValueError(f"no table {table!r} in {path}")
    return T.StructType([T.StructField(c[1], spark_type(c[2] or "")) for c in columns])


@dataclass
class IdRange(InputPartition):
    """Rows with `low <= id < high`; an open end also takes null ids below."""

    low: int | None = None
    high: int | None = None


def split_range(low: int | None, high: int | None, parts: int) -> list[IdRange]:
    """Ranges that cover all ids; a single one when there is nothing to split."""
    if low is None or high is None or low == high or parts < 2:
        return [IdRange()]
    parts = min(parts, high - low)
    cuts = [low + (high - low) * i // parts for i in range(1, parts)]
    return [IdRange(a, b) for a, b in zip([None, *cuts], [*cuts, None])]


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[IdRange]:
        column = self.options.get("partitioncolumn")
        if not column:
            return [IdRange()]
        with _open(self.options["path"]) as db:
            low, high = db.execute(
                f"SELECT min({_name(column)}), max({_name(column)}) FROM {_name(self.options['table'])}"
            ).fetchone()
        return split_range(low, high, int(self.options.get("numpartitions", 8)))

    def read(self, partition: IdRange) -> Iterator[tuple]:
        column = _name(self.options.get("partitioncolumn", ""))
        parts, values = [], []
        if partition.low is not None:
            parts.append(f"{column} >= ?")
            values.append(partition.low)
        elif partition.high is not None:
            parts.append(f"({column} < ? OR {column} IS NULL)")
            values.append(partition.high)
        if partition.low is not None and partition.high is not None:
            parts.append(f"{column} < ?")
            values.append(partition.high)
        names = ", ".join(_name(f.name) for f in self.schema.fields)
        sql = f"SELECT {names} FROM {_name(self.options['table'])}" + (f" WHERE {' AND '.join(parts)}" if parts else "")
        casts = [_CONVERT[f.dataType] for f in self.schema.fields]
        with _open(self.options["path"]) as db:
            for row in db.execute(sql, values):
                yield tuple(None if v is None else cast(v) for cast, v in zip(casts, row))


class SqliteTable(DataSource):
    """`spark.read.format("sqlite_table")` with options path, table, partitionColumn, numPartitions."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return table_schema(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_sqlite(
    spark: SparkSession, path: str, table: str, partition_column: str | None = None, partitions: int = 8
) -> DataFrame:
    """One table; with a partition column it is read in id ranges."""
    spark.dataSource.register(SqliteTable)
    reader = spark.read.format(FORMAT).option("path", path).option("table", table)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("numPartitions", str(partitions))
    return reader.load()
