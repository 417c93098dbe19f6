"""Batch folders: writing each micro-batch so that a retry overwrites itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

BATCH = "batch_id"


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Replace the folder of one batch; a batch that runs again leaves no duplicates."""
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before a batch. No batches yet means no rows."""
    full = f"{schema}, {BATCH} BIGINT"
    try:
        rows = spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return rows if before is None else rows.filter(F.col(BATCH) < before)


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Start `handle(rows, batch_id)` per micro-batch; `once` drains what is there and stops."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
