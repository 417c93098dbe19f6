"""Load manifests arriving as JSON files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.streaming.batches import run_batches, write_batch

# Manifest fields; the first three are required.
MANIFEST_SCHEMA = (
    "file_path STRING, file_type STRING, table_name STRING, detected_at STRING, file_size BIGINT, file_hash STRING"
)
REQUIRED = ("file_path", "file_type", "table_name")

LOADED_SCHEMA = "manifest STRING, status STRING, reason STRING"


def manifest_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New manifest files, one row per file: `manifest` and its whole text."""
    files = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return files.select(F.col("_metadata.file_name").alias("manifest"), "value")


def check_manifests(files: DataFrame) -> DataFrame:
    """Parsed manifest fields, and `reason` where a manifest cannot be used."""
    parsed = files.withColumn("m", F.from_json("value", MANIFEST_SCHEMA)).withColumn("v", F.try_parse_json("value"))
    absent = [
        F.when(~_has(F.col("v"), name), f"missing field: {name}") for name in REQUIRED
    ]
    invalid = F.when(F.col("v").isNull() | (F.schema_of_variant("v").substr(1, 6) != "OBJECT"), "invalid JSON")
    return parsed.select("manifest", "m.*", F.coalesce(invalid, *absent).alias("reason"))


def _has(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", "variant").isNotNull()


def process_manifests(
    stream: DataFrame, load: Callable[[dict], None], log_path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Load every new manifest once, in name order; outcomes go to `log_path`.

    `load` starts the load of one manifest, itself a Spark job. What reaches
    the driver is a batch of manifests, bounded by the stream's files per batch.
    """

    def handle(files: DataFrame, batch_id: int) -> None:
        outcomes = []
        for row in check_manifests(files).orderBy("manifest").collect():
            reason = row["reason"]
            if reason is None:
                try:
                    load(row.asDict())
                except Exception as error:  # recorded, the others go on
                    reason = f"load failed: {error}"
            outcomes.append((row["manifest"], "failed" if reason else "processed", reason))
        write_batch(files.sparkSession.createDataFrame(outcomes, LOADED_SCHEMA), log_path, batch_id)

    return run_batches(stream, handle, checkpoint, once)
