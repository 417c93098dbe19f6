import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from quarry.sources import warehouse
from quarry.sources.snapshots import KeyedFolders, drop_months
from quarry.sources.versioned import VersionedTable

SCHEMA = "file_id INT, chunk INT, text STRING"


def files_of(path):
    """Data files of every folder with their times."""
    found = glob.glob(f"{path}/*=*/*.parquet")
    return {f: os.stat(f).st_mtime_ns for f in found}


def folder_of(file):
    return int(re.search(r"=(\d+)/", file).group(1))


@pytest.fixture
def table(spark, tmp_path):
    table = KeyedFolders(spark, str(tmp_path / "chunks"), SCHEMA, "file_id", 16)
    table.replace(spark.createDataFrame([(k, i, f"{k}.{i}") for k in [*range(40), None] for i in range(3)], SCHEMA))
    return table


def expected(changed=(), gone=()):
    return sorted(
        ((k, i, f"{k}.{i}") for k in [*range(40), None] if k not in changed and k not in gone for i in range(3)), key=str
    )


def test_upsert_rewrites_only_the_folders_of_its_keys(spark, table):
    before = files_of(table.path)
    incoming = spark.createDataFrame([(3, 0, "new"), (99, 0, "more"), (None, 0, "null")], SCHEMA)
    touched = table.replace(incoming)
    after = files_of(table.path)
    assert 0 < len(touched) <= 3
    kept = {f for f in before if folder_of(f) not in touched}
    assert kept and all(after[f] == before[f] for f in kept)
    assert {f for f in after if f not in before} and all(folder_of(f) in touched for f in after if f not in before)
    got = sorted(map(tuple, table.read().collect()), key=str)
    assert got == sorted([*expected(changed=(3, None)), (3, 0, "new"), (99, 0, "more"), (None, 0, "null")], key=str)
    table.replace(incoming)  # the same again changes nothing
    assert sorted(map(tuple, table.read().collect()), key=str) == got


def test_delete_writes_keys_and_compact_rewrites_their_folders(spark, table):
    before = files_of(table.path)
    table.delete(spark.createDataFrame([(5,), (6,), (1234,), (None,)], "file_id INT"))
    assert files_of(table.path) == before
    assert sorted(map(tuple, table.read().collect()), key=str) == expected(gone=(5, 6, None))
    touched = table.compact()
    after = files_of(table.path)
    assert all(after[f] == t for f, t in before.items() if folder_of(f) not in touched)
    assert table.compact() == []
    assert sorted(map(tuple, table.read().collect()), key=str) == expected(gone=(5, 6, None))
    # A key may come back after it was deleted, before and after its folder is rewritten.
    table.delete(spark.createDataFrame([(7,)], "file_id INT"))
    table.replace(spark.createDataFrame([(7, 0, "7.0"), (7, 1, "7.1"), (7, 2, "7.2")], SCHEMA))
    assert sorted(map(tuple, table.read().collect()), key=str) == expected(gone=(5, 6, None))


def test_a_folder_may_become_empty(spark, tmp_path):
    table = KeyedFolders(spark, str(tmp_path / "t"), SCHEMA, "file_id", 4)
    assert table.read().count() == 0 and table.compact() == []
    table.replace(spark.createDataFrame([(1, 0, "a")], SCHEMA))
    table.delete(spark.createDataFrame([(1,)], "file_id INT"))
    table.compact()
    assert table.read().count() == 0 and files_of(table.path) == {}


def test_old_months_are_dropped_as_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    days = spark.range(120).select(F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_dt_interval(CAST(id AS INT))").alias("time"), "id", F.lit("A").alias("symbol"))
    warehouse.append_by_month(days, path, "time", tasks=2)
    before = files_of(path)
    cutoff = F.lit("2024-03-10 00:00:00").cast("timestamp_ntz")
    touched = drop_months(spark, path, "time TIMESTAMP_NTZ, id BIGINT, symbol STRING", "time", cutoff)
    assert sorted(folder_of(f + "/") for f in touched) == [202401, 202402, 202403]
    after = files_of(path)
    assert {folder_of(f) for f in after} == {202403, 202404}
    assert all(after[f] == t for f, t in before.items() if folder_of(f) == 202404)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(69, 120))
    assert drop_months(spark, path, "time TIMESTAMP_NTZ, id BIGINT, symbol STRING", "time", F.lit("2030-01-01").cast("timestamp_ntz"))
    assert files_of(path) == {}


VERSIONS = "k INT, part STRING, ver INT, seq BIGINT, v STRING"


def test_latest_versions_are_read_without_exchange(spark, tmp_path, rows):
    table = VersionedTable(spark, "quarry_test_versions", str(tmp_path / "v"), VERSIONS, ("k", "part"), "ver", ("seq",), 8).bind()
    table.append(spark.createDataFrame([(i % 50, "a", 1, i, f"one {i}") for i in range(100)], VERSIONS), 0)
    table.append(spark.createDataFrame([(i, "a", 2 if i % 2 else 0, 0, f"two {i}") for i in range(25)] + [(None, None, 1, 1, "null")], VERSIONS), 1)
    table.append(spark.createDataFrame([(1, "a", 2, 0, "later load")], VERSIONS), 2)
    latest = table.latest()
    assert "Exchange" not in latest._jdf.queryExecution().executedPlan().toString()
    want = {(i, "a"): f"one {i + 50}" for i in range(50)} | {(i, "a"): f"two {i}" for i in range(25) if i % 2} | {(None, None): "null", (1, "a"): "later load"}
    assert {(r.k, r.part): r.v for r in latest.collect()} == want
    # A load that runs again replaces itself.
    table.append(spark.createDataFrame([(1, "a", 2, 0, "later load")], VERSIONS), 2)
    assert table.table().df.count() == 127
    table.merge()
    assert table.loads() == [2] and table.table().df.count() == len(want)
    assert {(r.k, r.part): r.v for r in table.latest().collect()} == want
    table.append(spark.createDataFrame([(1, "a", 2, 0, "last")], VERSIONS), 3)
    again = VersionedTable(spark, "quarry_test_bound_again", table.path, VERSIONS, ("k", "part"), "ver", ("seq",), 8).bind()
    assert {(r.k, r.part): r.v for r in again.latest().collect()} == {**want, (1, "a"): "last"}
    assert "Exchange" not in again.latest()._jdf.queryExecution().executedPlan().toString()
    for name in (table.name, again.name):
        spark.sql(f"DROP TABLE {name}")
