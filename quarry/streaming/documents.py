"""Incremental document scan and upload de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.catalog import scan_decision
from quarry.operators.ranking import top_n
from quarry.operators.versions import latest_version
from quarry.sources.documents import WHOLE_BYTES, long_hashes, named_files, size_limit, visible_files
from quarry.streaming.batches import BATCH, read_batches, run_batches, write_batch
from quarry.streaming.state import KeyedState

CATALOG_SCHEMA = (
    "project_id BIGINT, file_hash STRING, path STRING, file_name STRING, file_type STRING,"
    " decision STRING, process_status STRING"
)

STATE_SCHEMA = "file_hash STRING, project_id BIGINT, process_status STRING"

Ingest = Callable[[DataFrame], DataFrame]


def document_stream(
    spark: SparkSession, root: str, files_per_batch: int = 1000, max_bytes: int | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """New files below a folder, as the batch scan returns them.

    The size is judged before anything is read: larger files come without content and hash. So do those above `whole_bytes`
    that are not too large; `long_uri` names them, and `scan_stream` reads them in parts.
    """
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    limit = size_limit(spark, max_bytes)
    whole = min(limit, whole_bytes)

    def files() -> DataFrame:
        reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True)
        return reader.option("maxFilesPerTrigger", files_per_batch).load(root)

    # The filter on the length reaches the source, which then opens no larger file.
    usual = files().filter(F.col("length") <= whole).select("path", "length", "content")
    large = files().filter(F.col("length") > whole).select("path", "length", F.lit(None).cast("binary").alias("content"))
    long_uri = F.when((F.col("length") > whole) & (F.col("length") <= limit), F.col("path")).alias("long_uri")
    return visible_files(usual.unionByName(large), root, long_uri)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The current entry per project and content; files that were never read go by their path."""
    rows = read_batches(spark, path, CATALOG_SCHEMA).filter(F.col("decision") != "skipped")
    unread = F.when(F.col("file_hash").isNull(), F.col("path"))
    return latest_version(rows.withColumn("__unread", unread), ["project_id", "file_hash", "__unread"], BATCH, ["path"]).drop("__unread")


def project_of(path: Column) -> Column:
    """The project that a folder `project_<id>` on the path names, else the base project 0."""
    return F.coalesce(F.regexp_extract(path, r"(?:^|/)project_(\d+)/", 1).try_cast("long"), F.lit(0).cast("long"))


def scan_stream(
    files: DataFrame, path: str, checkpoint: str, ingest: Ingest | None = None, force: bool = False, once: bool = True
) -> StreamingQuery:
    """Decide about every new file and record it in the catalog at `path`.

    `ingest` receives the files to process and returns `(file_hash, status)`;
    without it they count as ready. Copies within a batch are decided once. Files without content, too large
    to be read, are recorded as failed, each on its own. Long files are hashed in parts by several tasks, and read whole only if
    `ingest` uses their content. What is known is keyed state beside the catalog, of which a
    batch writes what it has decided.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        state = KeyedState(spark, f"{path}-known", STATE_SCHEMA, ["file_hash", "project_id"])
        state.clean(batch_id)
        # A stream's rows come whole from the source each time, so all but the content is kept.
        listed = rows.drop("content").withColumn("project_id", project_of(F.col("path"))).persist()
        long = [r["long_uri"] for r in listed.filter(F.col("long_uri").isNotNull()).select("long_uri").collect()]
        scanned, contents = listed, rows.select("path", "content")
        if long:
            hashes = long_hashes(spark, long).select(F.col("uri").alias("long_uri"), F.col("file_hash").alias("__hash"))
            scanned = listed.join(hashes, "long_uri", "left").withColumn("file_hash", F.coalesce("file_hash", "__hash")).drop("__hash").persist()
            uris = listed.select("path", F.col("long_uri").alias("uri"))
            large = uris.join(named_files(spark, long).select("uri", F.col("content").alias("__content")), "uri").drop("uri")
            contents = contents.join(large, "path", "left").select("path", F.coalesce("content", "__content").alias("content"))
        try:
            # Content stays behind until it is clear which files are wanted.
            readable = scanned.drop("long_uri").filter(F.col("file_hash").isNotNull())
            first = top_n(readable, ["project_id", "file_hash"], [F.col("path").asc()], 1)
            decided = scan_decision(first, state.read(batch_id), force)
            wanted = decided.filter(F.col("decision").isin("processed", "retried"))
            todo = wanted.join(contents, "path")
            done = ingest(todo) if ingest else todo.select("file_hash", F.lit("ready").alias("status"))
            status = F.when(F.col("decision") == "failed", "failed").otherwise(F.col("status"))
            entries = decided.join(done, "file_hash", "left").withColumn("process_status", status)
            names = [c.split()[0] for c in CATALOG_SCHEMA.split(", ")]
            too_large = scanned.filter(F.col("file_hash").isNull()).withColumns({"decision": F.lit("failed"), "process_status": F.lit("failed")})
            write_batch(entries.select(*names).unionByName(too_large.select(*names)), path, batch_id)
        finally:
            scanned.unpersist()
            listed.unpersist()
        new = read_batches(spark, path, CATALOG_SCHEMA).filter((F.col(BATCH) == batch_id) & (F.col("decision") != "skipped"))
        state.write(new.filter(F.col("file_hash").isNotNull()).select("file_hash", "project_id", "process_status"), batch_id)

    return run_batches(files, handle, checkpoint, once)


def first_uploads(uploads: DataFrame, within: str | None = "90 days", time: str = "uploaded_at") -> DataFrame:
    """First upload per project and content on a stream.

    State older than the span `within` is dropped, so a copy is recognised for at least that long.
    With `None` it is recognised for ever and the state only grows.
    """
    keys = ["project_id", "file_hash"]
    if within is None:
        return uploads.dropDuplicates(keys)
    return uploads.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
