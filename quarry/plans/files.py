"""Queries over the file catalog, access rules and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import catalog, retention
from quarry.plans.registry import query
from quarry.plans.tables import FILES
from quarry.session import scratch_path
from quarry.sources import warehouse
from quarry.sources.snapshots import KeyedFolders, drop_months, read_or_none

SCANS = f"""{FILES},
known AS (SELECT file_hash, file_id % 3 AS project, min(file_id) AS file_id FROM files WHERE project_id < 10 GROUP BY 1, 2),
listed AS (SELECT k.file_hash, k.project, f.process_status FROM known k JOIN files f USING (file_id)),
decided AS (
  SELECT f.file_id, CASE WHEN l.process_status = 'ready' OR l.process_status = 'deleted' THEN 'skipped'
                         WHEN f.file_type NOT IN ('pdf', 'md', 'txt', 'docx') THEN 'failed'
                         WHEN l.process_status IS NULL THEN 'processed' ELSE 'retried' END AS decision
  FROM files f LEFT JOIN listed l ON l.file_hash = f.file_hash AND l.project = f.file_id % 3)
"""


def _decided(data):
    """All files scanned into three projects, against a catalog of half of them."""
    files = data.files().withColumn("project", F.col("file_id") % 3)
    # One catalog row per project and content, the oldest.
    listed = files.filter("project_id < 10").groupBy("file_hash", F.col("project").alias("project_id")).agg(
        F.min(F.struct("file_id", "process_status"))["process_status"].alias("process_status")
    )
    scanned = files.select("file_id", "file_hash", "file_type", F.col("project").alias("project_id"))
    return catalog.scan_decision(scanned, listed)


@query("scan_decision", f"WITH {SCANS} SELECT file_id, decision FROM decided")
def _scan_decision(data):
    return _decided(data).select("file_id", "decision")


@query("scan_summary", f"WITH {SCANS} SELECT decision, count(*) AS files FROM decided GROUP BY 1")
def _scan_summary(data):
    return catalog.scan_summary(_decided(data))


@query(
    "dedup_uploads",
    f"""
    WITH {FILES}, f AS (SELECT *, project_id % 3 AS project FROM files)
    SELECT project, file_hash, min(file_id) AS file_id FROM f x WHERE NOT EXISTS (
      SELECT 1 FROM f y WHERE y.process_status = 'ready' AND y.project = x.project AND y.file_hash = x.file_hash)
    GROUP BY 1, 2
    """,
)
def _dedup_uploads(data):
    files = data.files().withColumn("project_id", F.col("project_id") % 3)
    fresh = catalog.dedup_uploads(files.drop("text"), files)
    return fresh.select(F.col("project_id").alias("project"), "file_hash", "file_id")


@query(
    "files_list",
    f"WITH {FILES} SELECT file_id, project_id, file_name, process_status FROM files WHERE process_status <> 'deleted'",
)
def _files_list(data):
    return catalog.list_files(data.files()).select("file_id", "project_id", "file_name", "process_status")


@query(
    "files_list_project",
    f"WITH {FILES} SELECT file_id, file_name FROM files WHERE process_status <> 'deleted' AND project_id = 3",
)
def _files_list_project(data):
    return catalog.list_files(data.files(), project_id=3).select("file_id", "file_name")


@query(
    "ready_counts",
    f"""
    WITH {FILES}, p AS (SELECT DISTINCT project_id AS asked FROM files)
    SELECT asked, count(file_id) AS files, count(file_id) > 0 AS any_ready FROM p
    LEFT JOIN files ON process_status = 'ready' AND (project_id = asked OR (asked > 0 AND project_id = 0)) GROUP BY 1
    """,
)
def _ready_counts(data):
    return catalog.ready_counts(data.files())


@query(
    "filter_scope",
    "SELECT vec_id, CAST(label AS BIGINT) AS project_id FROM embeddings WHERE label IN (0, 4)",
)
def _filter_scope(data):
    project = F.col("label").cast("long")
    rows = data.table("embeddings").select("vec_id", project.alias("project_id"))
    return rows.filter(catalog.in_scope(F.col("project_id"), 4))


ACCESS = """
projects AS (SELECT c_custkey - 200 AS project_id, CAST(c_nationkey AS BIGINT) AS owner FROM customer),
requests AS (SELECT o_orderkey AS request_id, o_custkey - 200 AS project_id, o_orderkey % 25 AS user_id FROM orders),
access AS (
  SELECT request_id, r.project_id, user_id, r.project_id <= 0 OR (user_id <> 0 AND coalesce(owner = user_id, false)) AS allowed
  FROM requests r LEFT JOIN projects p ON p.project_id = r.project_id)
"""


def _access_inputs(data):
    projects = data.table("customer").select(
        (F.col("c_custkey") - 200).alias("project_id"), F.col("c_nationkey").cast("long").alias("user_id")
    )
    requests = data.table("orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") - 200).alias("project_id"), (F.col("o_orderkey") % 25).alias("user_id")
    )
    return requests, projects


@query("access_matrix", f"WITH {ACCESS} SELECT request_id, project_id, user_id, allowed FROM access")
def _access_matrix(data):
    return catalog.project_access(*_access_inputs(data)).select("request_id", "project_id", "user_id", "allowed")


@query(
    "session_access",
    f"WITH {ACCESS} SELECT request_id, allowed AND NOT (user_id = 0 AND project_id = 0) AS allowed FROM access",
)
def _session_access(data):
    return catalog.session_access(*_access_inputs(data)).select("request_id", "allowed")


# Retention -------------------------------------------------------------------------
@query(
    "purge_files",
    f"""
    WITH {FILES}
    SELECT file_id, process_status FROM files
    WHERE NOT (process_status = 'deleted' AND process_at <= TIMESTAMP '2024-01-01 06:00:00' - INTERVAL 60 MINUTES)
    """,
)
def _purge_files(data):
    files = data.files().drop("text")
    kept, _ = retention.purge_files(files, files.select("file_id"), "2024-01-01 06:00:00")
    return kept.select("file_id", "process_status")


@query(
    "purge_file_chunks",
    """
    SELECT l_orderkey AS file_id, count(*) AS chunks FROM lineitem WHERE l_orderkey NOT IN (
      SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 60 MINUTES)
    GROUP BY 1
    """,
)
def _purge_file_chunks(data):
    status = F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("ready")
    files = data.table("orders").select(
        F.col("o_orderkey").alias("file_id"), status.alias("process_status"), F.col("o_orderdate").alias("process_at")
    )
    chunks = data.table("lineitem").select(F.col("l_orderkey").alias("file_id"))
    _, kept = retention.purge_files(files, chunks, "2001-01-01 00:00:00")
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))


GROUPS = """
groups AS (SELECT c_custkey - 750 AS project_id FROM customer),
sessions AS (SELECT o_orderkey AS session_id, o_custkey - 750 AS project_id, o_orderdate AS update_at FROM orders WHERE o_orderpriority <> '5-LOW'),
gone AS (
  SELECT g.project_id FROM groups g LEFT JOIN sessions s USING (project_id) WHERE g.project_id < 0 GROUP BY 1
  HAVING max(update_at) IS NULL OR max(update_at) < TIMESTAMP '2001-03-01' - INTERVAL 24 HOURS)
"""


def _groups(data):
    groups = data.table("customer").select((F.col("c_custkey") - 750).alias("project_id"))
    sessions = data.table("orders").filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") - 750).alias("project_id"), F.col("o_orderdate").alias("update_at")
    )
    return groups, sessions


@query("purge_groups", f"WITH {GROUPS} SELECT project_id FROM groups WHERE project_id NOT IN (SELECT project_id FROM gone)")
def _purge_groups(data):
    kept, _ = retention.purge_private_groups(*_groups(data), "2001-03-01 00:00:00")
    return kept


@query(
    "purge_group_sessions",
    f"WITH {GROUPS} SELECT session_id, project_id FROM sessions WHERE project_id NOT IN (SELECT project_id FROM gone)",
)
def _purge_group_sessions(data):
    _, kept = retention.purge_private_groups(*_groups(data), "2001-03-01 00:00:00")
    return kept.select("session_id", "project_id")


@query(
    "trim_events",
    """
    SELECT event_id FROM events WHERE NOT (user_id < 60 AND ts < TIMESTAMP '2024-01-28' - INTERVAL 7 DAYS)
    """,
)
def _trim_events(data):
    """Sessions are the users; those below 60 belong to private groups."""
    events = data.table("events").select("event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("create_at"))
    sessions = events.select("session_id", (F.col("session_id") - 60).alias("project_id"))
    return retention.trim_private_events(events, sessions, "2024-01-28 00:00:00").select("event_id")


@query("ttl_filter", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-28' - INTERVAL 10 DAYS")
def _ttl_filter(data):
    kept = retention.within_ttl(data.table("events"), "ts", "2024-01-28 00:00:00", "INTERVAL 10 DAYS")
    return kept.select("event_id")


@query("ttl_months", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-28' - INTERVAL 10 DAYS")
def _ttl_months(data):
    """The same on a table in month folders: old months go as folders, only the month of the limit is rewritten."""
    path = scratch_path(data.spark, "log-months")
    events = data.table("events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("time"), F.col("event_type").alias("symbol"))
    warehouse.append_by_month(events, path, "time")
    schema = "event_id BIGINT, time TIMESTAMP_NTZ, symbol STRING"
    drop_months(data.spark, path, schema, "time", F.expr("TIMESTAMP_NTZ '2024-01-28 00:00:00' - INTERVAL 10 DAYS"))
    return read_or_none(data.spark, path, schema).select("event_id")


@query(
    "purge_chunks_stored",
    """
    SELECT l_orderkey AS file_id, count(*) AS chunks FROM lineitem WHERE l_orderkey NOT IN (
      SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 60 MINUTES)
    GROUP BY 1
    """,
)
def _purge_chunks_stored(data):
    """Expired files as tombstones of a stored collection; no chunk is read or written to delete."""
    status = F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("ready")
    files = data.table("orders").select(
        F.col("o_orderkey").alias("file_id"), status.alias("process_status"), F.col("o_orderdate").alias("process_at")
    )
    table = KeyedFolders(data.spark, scratch_path(data.spark, "collection"), "file_id BIGINT, chunk_index INT", "file_id")
    table.replace(data.table("lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("int").alias("chunk_index")))
    table.delete(retention.expired_files(files, "2001-01-01 00:00:00"))
    return table.read().groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
