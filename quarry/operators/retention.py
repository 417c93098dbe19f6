"""Retention: what is purged, and what is kept, as new snapshots.

Parquet has no row deletes, so every job returns the rows to keep; the caller
writes them as a new snapshot folder. Key sets are aggregated before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grace periods.
DELETED_GRACE = "INTERVAL 60 MINUTES"
PRIVATE_GROUP_TTL = "INTERVAL 24 HOURS"
PRIVATE_EVENT_TTL = "INTERVAL 7 DAYS"
LOG_TTL = "INTERVAL 90 DAYS"


def _before(now: str, interval: str) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.expr(interval)


def expired_files(files: DataFrame, now: str) -> DataFrame:
    """Files flagged deleted for at least the grace period."""
    return files.filter((F.col("process_status") == "deleted") & (F.col("process_at") <= _before(now, DELETED_GRACE)))


def purge_files(files: DataFrame, chunks: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Files and chunks that remain after expired files are gone."""
    gone = expired_files(files, now).select("file_id")
    return files.join(gone, "file_id", "left_anti"), chunks.join(gone, "file_id", "left_anti")


def stale_groups(groups: DataFrame, sessions: DataFrame, cutoff: Column) -> DataFrame:
    """Groups without sessions or whose newest session is older than `cutoff`."""
    newest = sessions.groupBy("project_id").agg(F.max("update_at").alias("newest"))
    joined = groups.join(newest, "project_id", "left")
    return joined.filter(F.col("newest").isNull() | (F.col("newest") < cutoff))


def purge_private_groups(groups: DataFrame, sessions: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Groups and sessions that remain after stale private groups (id below 0) are gone."""
    private = groups.filter(F.col("project_id") < 0)
    gone = stale_groups(private, sessions, _before(now, PRIVATE_GROUP_TTL)).select("project_id")
    return groups.join(gone, "project_id", "left_anti"), sessions.join(gone, "project_id", "left_anti")


def trim_private_events(events: DataFrame, sessions: DataFrame, now: str) -> DataFrame:
    """Events that remain: all but the old ones of sessions in private groups."""
    private = sessions.filter(F.col("project_id") < 0).select("session_id").distinct()
    old = F.coalesce(F.col("create_at") < _before(now, PRIVATE_EVENT_TTL), F.lit(False))
    marked = events.join(private.withColumn("__private", F.lit(True)), "session_id", "left")
    return marked.filter(F.col("__private").isNull() | ~old).drop("__private")


def within_ttl(rows: DataFrame, time: str, now: str, ttl: str = LOG_TTL) -> DataFrame:
    """Rows that are not older than the time to live."""
    return rows.filter(F.col(time) > _before(now, ttl))
