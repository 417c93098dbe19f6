"""File catalog, access rules, scan decisions and upload de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators.ranking import top_n

# Accepted file types and size limits.
SUPPORTED_TYPES = ("pdf", "md", "txt", "docx")
RETRY_STATES = ("failed", "pending", "processing")


def in_scope(project: Column, asked: int) -> Column:
    """Projects a search may see: a private one only itself, others also the base 0."""
    return project.isin(*sorted({asked, 0})) if asked > 0 else project == asked


def scope_list(asked: Column) -> Column:
    """The same rule for a column of asked projects, as an array."""
    zero = F.lit(0).cast("long")
    return F.when(asked > 0, F.array(zero, asked)).otherwise(F.array(asked))


def project_access(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Add `allowed`: negative and base projects are open, others belong to their owner.

    User 0 is a guest and owns nothing. `projects` has unique `project_id`s.
    """
    owners = projects.select("project_id", F.col("user_id").alias("__owner"))
    project, user = F.col("project_id"), F.col("user_id")
    allowed = (project <= 0) | ((user != 0) & (F.coalesce(F.col("__owner"), F.lit(-1)) == user))
    return requests.join(owners, "project_id", "left").withColumn("allowed", allowed).drop("__owner")


def session_access(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """As above for sessions, with the base project closed to guests."""
    guest_in_base = (F.col("user_id") == 0) & (F.col("project_id") == 0)
    return project_access(requests, projects).withColumn("allowed", F.col("allowed") & ~guest_in_base)


def list_files(files: DataFrame, **owner) -> DataFrame:
    """Files that are not deleted, by name; optionally of one project or user."""
    for column, value in owner.items():
        files = files.filter(F.col(column) == value)
    return files.filter(F.col("process_status") != "deleted").orderBy("file_name")


def scan_decision(scanned: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """Add `decision` to scanned files by looking up `(file_hash, project_id)`.

    New files are processed, ready ones skipped (or retried when forced),
    unfinished ones retried, anything else skipped. What would be processed but
    has an unsupported type fails.
    """
    known = catalog.select("file_hash", "project_id", F.col("process_status").alias("__state"))
    state = F.col("__state")
    again = state.isin(*RETRY_STATES, *(("ready",) if force else ()))
    unsupported = ~F.col("file_type").isin(*SUPPORTED_TYPES)
    decision = (
        F.when(state.isNotNull() & ~again, "skipped")
        .when(unsupported, "failed")
        .when(state.isNull(), "processed")
        .otherwise("retried")
    )
    return scanned.join(known, ["file_hash", "project_id"], "left").withColumn("decision", decision).drop("__state")


def scan_summary(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("files"))


def ready_counts(files: DataFrame) -> DataFrame:
    """Ready files that each project may see: `asked`, `files`, and whether there are any.

    Files are counted per project before the scope is looked up.
    """
    per_project = files.groupBy("project_id").agg(F.count_if(F.col("process_status") == "ready").alias("ready"))
    asked = per_project.select(F.col("project_id").alias("asked"), F.explode(scope_list(F.col("project_id"))).alias("project_id"))
    visible = asked.join(per_project, "project_id", "left").groupBy("asked").agg(F.coalesce(F.sum("ready"), F.lit(0)).alias("files"))
    return visible.select("asked", "files", (F.col("files") > 0).alias("any_ready"))


def sessions_by_owner(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """Sessions with the owner of their project, per owner the newest first."""
    owned = sessions.join(projects.select("project_id", "user_id"), "project_id")
    return owned.orderBy("user_id", F.col("update_at").desc(), "session_id")


def dedup_uploads(uploads: DataFrame, catalog: DataFrame) -> DataFrame:
    """First upload per project and content that has no ready file yet."""
    ready = catalog.filter(F.col("process_status") == "ready").select("project_id", "file_hash").distinct()
    fresh = uploads.join(ready, ["project_id", "file_hash"], "left_anti")
    return top_n(fresh, ["project_id", "file_hash"], [F.col("file_id").asc()], 1)


def ingest_status(
    files: DataFrame, chunk_counts: DataFrame, max_bytes: int | None = None, min_chars: int = 1
) -> DataFrame:
    """Outcome per file: the first failed check, or ready with its number of chunks.

    Files of any size are accepted unless `max_bytes` is given, and texts from `min_chars` on.

    `files` has `file_type`, `file_bytes` and `text`; a missing `vectors` column
    in `chunk_counts` means that every chunk was embedded.
    """
    counts = chunk_counts
    if "vectors" not in counts.columns:
        counts = counts.withColumn("vectors", F.col("chunks"))
    chunks = F.coalesce("chunks", F.lit(0))
    text = strip(F.coalesce("text", F.lit("")))
    error = (
        F.when(~F.lower(F.btrim("file_type", F.lit("."))).isin(*SUPPORTED_TYPES), "unsupported file type")
        .when(F.lit(False) if max_bytes is None else F.col("file_bytes") > max_bytes, "file too large")
        .when(F.length(text) < min_chars, "no extractable text")
        .when(chunks == 0, "no usable chunks")
        .when(F.col("vectors") != F.col("chunks"), "embedding count mismatch")
    )
    return (
        files.join(counts, "file_id", "left")
        .withColumn("error", error)
        .select(
            "file_id",
            F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"),
            F.when(F.col("error").isNull(), chunks).otherwise(0).cast("long").alias("chunks_count"),
            "error",
        )
    )
