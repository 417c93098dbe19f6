"""Append-only tables of row versions whose latest versions are read without a shuffle.

A table is bucketed and sorted by its keys, and has a folder per load. All versions of a key are in the same bucket in every
load, so the newest one is found inside a task. A load only deals out its own rows; one that runs again replaces
itself. `merge` writes the latest versions of all loads into the last one and drops the others, so that
the files of a bucket stay few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.versions import Table, latest_version
from quarry.session import scratch_path
from quarry.sources.snapshots import delete_folders, folder_names

LOAD = "load_no"
BUCKETS = 64


@dataclass(frozen=True)
class VersionedTable:
    """A table `name` of the session over the files at `path`; rows of `schema`, replaced by `keys` and `version`.

    The name and the files may be bound again in another session. Of equal versions the later load wins, within a load the highest `tie`.
    """

    spark: SparkSession
    name: str
    path: str
    schema: str
    keys: tuple[str, ...]
    version: str | None = None
    tie: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def bind(self) -> VersionedTable:
        """Make the table known to the session; files that are there already are used."""
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}, {LOAD} BIGINT) USING parquet PARTITIONED BY ({LOAD}) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if self.loads():
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self

    def append(self, rows: DataFrame, load: int) -> None:
        """Write a load, or write it again; a task writes one bucket."""
        columns = [c for c in self.spark.table(self.name).columns if c != LOAD]
        dealt = rows.select(*columns, F.lit(load).cast("long").alias(LOAD)).repartition(self.buckets, *self.keys)
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            dealt.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self.name)

    def table(self) -> Table:
        """All versions, to be read through `Table.read`."""
        return Table(self.spark.table(self.name), self.keys, self.version, (LOAD, *self.tie))

    def latest(self) -> DataFrame:
        return self.table().read().drop(LOAD)

    def loads(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in folder_names(self.spark, self.path, LOAD))

    def merge(self) -> None:
        """Keep the latest versions only, in the last load. Until the other loads are dropped, both forms read the same."""
        loads = self.loads()
        if not loads:
            return
        staged_path = scratch_path(self.spark, "merged")
        latest = latest_version(self.spark.table(self.name), self.keys, self.version, (LOAD, *self.tie))
        latest.drop(LOAD).write.parquet(staged_path)
        self.append(self.spark.read.schema(latest.drop(LOAD).schema).parquet(staged_path), loads[-1])
        for load in loads[:-1]:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({LOAD} = {load})")
        delete_folders(self.spark, [f"{self.path}/{LOAD}={n}" for n in loads[:-1]])
        self.spark.catalog.refreshTable(self.name)
