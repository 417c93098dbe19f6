"""Stored tables of which a small change rewrites a small part.

`KeyedFolders` deals rows to folders by a hash of their key. New rows of some keys rewrite the folders of these
keys only; a deletion writes the keys as tombstones and no row at all, until `compact` rewrites the folders that have any.
`drop_months` forgets whole month folders without reading a row. Folders that a change does not touch keep their files.

A change is staged in the shared folder first and then replaces its folders (dynamic partition
overwrite), so it can be run again at any point. There is one writer at a time.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.dates import month_key
from quarry.session import scratch_path
from quarry.sources.warehouse import MONTH

FOLDER, GENERATION = "key_folder", "key_generation"
TOMBSTONES = "_tombstones"
FOLDERS = 64


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a Parquet folder; a folder that is not there has none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_folders(rows: DataFrame, path: str, by: str) -> None:
    """Replace the folders `by=...` that `rows` have; others stay. A folder that is too large for one task has several files."""
    together = rows.hint("rebalance", by)
    together.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def delete_folders(spark: SparkSession, folders: Sequence[str]) -> None:
    context = spark.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def folder_names(spark: SparkSession, path: str, by: str) -> list[str]:
    """Names of the folders `by=...` directly below a path."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [status.getPath().getName() for status in system.listStatus(root)]
    return sorted(n for n in names if n.startswith(f"{by}="))


@dataclass(frozen=True)
class KeyedFolders:
    """A table at `path` with rows of `schema`, in `folders` folders by the hash of `key`. Null keys are a key."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    folders: int = FOLDERS

    def _folder(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.folders)).cast("int")

    def _foldered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({GENERATION: F.lit(time.time_ns()), FOLDER: self._folder(F.col(self.key))})

    def _rows(self) -> DataFrame:
        return read_or_none(self.spark, self.path, f"{self.schema}, {GENERATION} BIGINT, {FOLDER} INT")

    def _tombstones(self) -> DataFrame:
        kind = self._rows().schema[self.key].dataType.simpleString()
        gone = read_or_none(self.spark, f"{self.path}/{TOMBSTONES}", f"{self.key} {kind}, {GENERATION} BIGINT, {FOLDER} INT")
        return gone.groupBy(self.key, FOLDER).agg(F.max(GENERATION).alias("__gone"))

    def _alive(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        named = gone.select(F.col(self.key).alias("__key"), F.col(FOLDER).alias("__folder"), "__gone")
        hidden = F.col(self.key).eqNullSafe(F.col("__key")) & (F.col(FOLDER) == F.col("__folder")) & (F.col(GENERATION) < F.col("__gone"))
        return rows.join(named, hidden, "left_anti")

    def read(self) -> DataFrame:
        """All rows that have not been deleted since they were written."""
        return self._alive(self._rows(), self._tombstones()).drop(GENERATION, FOLDER)

    def replace(self, incoming: DataFrame) -> list[int]:
        """Put the rows of `incoming` in place of all old rows of their keys; returns the folders rewritten."""
        staged = self._staged(self._foldered(incoming.select(*self._columns())))
        return self._rewrite(staged, sorted(r[FOLDER] for r in staged.select(FOLDER).distinct().collect()))

    def delete(self, keys: DataFrame) -> None:
        """Hide all rows of these keys. No row is read or written, only the keys."""
        gone = self._foldered(keys.select(self.key).distinct())
        gone.write.partitionBy(FOLDER).mode("append").parquet(f"{self.path}/{TOMBSTONES}")

    def compact(self) -> list[int]:
        """Rewrite the folders with deleted keys without the hidden rows; returns these folders."""
        names = folder_names(self.spark, f"{self.path}/{TOMBSTONES}", FOLDER)
        return self._rewrite(self._rows().limit(0), [int(n.split("=")[1]) for n in names])

    def _columns(self) -> list[str]:
        return [f.name for f in self._rows().schema.fields if f.name not in (GENERATION, FOLDER)]

    def _staged(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "staged")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _rewrite(self, incoming: DataFrame, touched: list[int]) -> list[int]:
        if not touched:
            return touched
        # There are few folders, so they are listed in the filter and prune the scan.
        own = F.col(FOLDER).isin(*touched)
        new_keys = incoming.select(F.col(self.key).alias("__key")).distinct()
        old = self._alive(self._rows().filter(own), self._tombstones().filter(own))
        kept = old.join(new_keys, F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")
        next_rows = self._staged(kept.unionByName(incoming))
        replace_folders(next_rows, self.path, FOLDER)
        left = {r[FOLDER] for r in next_rows.select(FOLDER).distinct().collect()}
        # A folder all of whose rows are gone is in no new file.
        empty = [f"{self.path}/{FOLDER}={f}" for f in touched if f not in left]
        delete_folders(self.spark, empty + [f"{self.path}/{TOMBSTONES}/{FOLDER}={f}" for f in touched])
        self.spark.catalog.refreshByPath(self.path)
        return touched


def drop_months(spark: SparkSession, path: str, schema: str, time_column: str, cutoff: Column) -> list[str]:
    """Remove rows not after `cutoff` from a table in month folders; returns the folders that were touched.

    Months before that of the cutoff are dropped as folders. Only the month of the cutoff is read and rewritten.
    """
    edge = spark.range(1).select(month_key(cutoff).cast("string").alias("m")).first()["m"]
    names = {n.split("=")[1]: n for n in folder_names(spark, path, MONTH)}
    old = [f"{path}/{n}" for m, n in names.items() if m.isdigit() and int(m) < int(edge)]
    touched = list(old)
    if edge in names:
        rows = spark.read.schema(f"{schema}, {MONTH} INT").parquet(path).filter(F.col(MONTH) == int(edge))
        kept = rows.filter(F.col(time_column) > cutoff)
        staged_path = scratch_path(spark, "month")
        kept.write.parquet(staged_path)
        staged = spark.read.schema(kept.schema).parquet(staged_path)
        touched.append(f"{path}/{names[edge]}")
        if staged.head(1):
            replace_folders(staged, path, MONTH)
        else:
            old.append(touched[-1])
    delete_folders(spark, old)
    spark.catalog.refreshByPath(path)
    return touched
