"""Streaming writes into a versioned table, and its compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.versions import Table
from quarry.streaming.batches import BATCH, read_batches, run_batches, write_batch

SEQUENCE, ORIGIN = "ingest_seq", "ingest_origin"
ORIGIN_TYPE = "STRUCT<time: TIMESTAMP, file: STRING, block: BIGINT, row: BIGINT>"
_FILE = ("file_modification_time", "file_path", "file_block_start")


def append_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append every micro-batch to its own folder with the origin of each row.

    For a stream of files that is the file, by time and name, the part of it and the place there; so
    that of equal versions the last row inserted can be told. Rows of other streams have a hash of the
    row only. Both are the same whenever and wherever a batch runs again.
    """
    columns = stream.columns
    try:
        placed = stream.select("*", F.struct(*(F.col(f"_metadata.{c}") for c in _FILE)).alias(ORIGIN))
    except AnalysisException:  # not a stream of files
        placed = stream.withColumn(ORIGIN, F.lit(None).cast("struct<file_modification_time: timestamp, file_path: string, file_block_start: bigint>"))

    def handle(rows: DataFrame, batch_id: int) -> None:
        # Numbers of a task rise along the part of the file that it reads.
        file = F.col(ORIGIN)
        origin = F.struct(file[_FILE[0]].alias("time"), file[_FILE[1]].alias("file"), file[_FILE[2]].alias("block"), F.monotonically_increasing_id().alias("row"))
        kept = rows.withColumns({ORIGIN: F.when(file.isNotNull(), origin), SEQUENCE: F.xxhash64(*columns)})
        write_batch(kept.withColumn(ORIGIN, F.col(ORIGIN).cast(ORIGIN_TYPE)), path, batch_id)

    return run_batches(placed, handle, checkpoint, once)


def versioned(spark: SparkSession, path: str, schema: str, keys: Sequence[str], version: str | None, tie: Sequence[str] = ()) -> Table:
    """The table behind a stream: between equal versions the `tie` columns decide, then the row inserted last.

    Rows carry the path of their file and a reading task has very many, so they are sorted after the shuffle only, in
    twice as many partitions as are read.
    """
    rows = read_batches(spark, path, f"{schema}, {ORIGIN} {ORIGIN_TYPE}, {SEQUENCE} BIGINT")
    return Table(rows, tuple(keys), version, (*tie, BATCH, ORIGIN, SEQUENCE), 2 * rows.rdd.getNumPartitions())


def compact(table: Table, target: str) -> None:
    """Write only the latest versions to a new folder; the old one stays readable."""
    table.read().write.mode("errorifexists").parquet(target)
