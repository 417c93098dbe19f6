"""Keyed state of a stream whose upkeep follows the batches.

A batch only hands in the keys it has changed. Parts of the state cover runs of batches, like the ones in a binary counter: batch
k (counted from 0) takes in the parts of the 2**z - 1 batches before it, where z is the number of zeros that k + 1
ends with, and writes one part with the newest row of each key. So a row is written again at most
log2(batches) times and that many parts are read. Parts that a larger one has taken in are removed when the next batch
starts, that is when the batch that wrote it is committed; a batch that runs again finds what it found before and
overwrites its own part. With `keep`, rows that are no longer wanted leave when they are taken in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.versions import latest_version
from quarry.sources.snapshots import delete_folders, folder_names

PART, AT = "part", "state_batch"


@dataclass(frozen=True)
class KeyedState:
    """Rows of `schema` at `path`, one per `keys`."""

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    keep: Column | None = None

    def parts(self) -> list[tuple[int, int]]:
        """Runs of batches (first, last) whose parts are complete."""
        names = [n.split("=")[1] for n in folder_names(self.spark, self.path, PART)]
        runs = [tuple(map(int, n.split("_"))) for n in names]
        return sorted(run for run in runs if self._complete(run))

    def read(self, before: int) -> DataFrame:
        """The newest row of every key after the batches before this one."""
        return self._newest(self._cover(before))

    def write(self, changed: DataFrame, batch: int) -> None:
        """Hand in the rows that a batch has changed, one per key."""
        span = (batch + 1) & -(batch + 1)
        earlier = [run for run in self._cover(batch) if run[0] >= batch + 1 - span]
        rows = changed.select(*self._columns(), F.lit(batch).cast("long").alias(AT))
        if earlier:
            replaced = changed.select(*(F.col(k).alias(f"__new_{k}") for k in self.keys))
            old = self._rows(earlier).join(replaced, [F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in self.keys], "left_anti")
            old = latest_version(old, self.keys, AT)
            rows = (old if self.keep is None else old.filter(F.coalesce(self.keep, F.lit(False)))).select(*rows.columns).unionByName(rows)
        first = earlier[0][0] if earlier else batch
        rows.write.mode("overwrite").parquet(self._folder((first, batch)))

    def clean(self, before: int) -> None:
        """Remove parts of earlier batches that are covered by larger ones; call it when those batches are committed."""
        kept = set(self._cover(before))
        delete_folders(self.spark, [self._folder(run) for run in self.parts() if run not in kept and run[1] < before])

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/{PART}={run[0]}_{run[1]}"

    def _complete(self, run: tuple[int, int]) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self._folder(run)}/_SUCCESS")
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def _cover(self, before: int) -> list[tuple[int, int]]:
        """The largest parts, end to end, that hold all batches before this one."""
        cover, last = [], -1
        for run in sorted((r for r in self.parts() if r[1] < before), key=lambda r: (r[0], -r[1])):
            if run[0] > last:
                cover.append(run)
                last = run[1]
        return cover

    def _rows(self, cover: Sequence[tuple[int, int]]) -> DataFrame:
        schema = f"{self.schema}, {AT} BIGINT"
        if not cover:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self._folder(run) for run in cover))

    def _newest(self, cover: Sequence[tuple[int, int]]) -> DataFrame:
        rows = self._rows(cover)
        return (latest_version(rows, self.keys, AT) if len(cover) > 1 else rows).drop(AT)
