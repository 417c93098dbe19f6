import dataclasses
import hashlib
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.sources import documents as document_files
from quarry.streaming import bars, batches, documents, manifests, sequence, upsert
from quarry.streaming.state import KeyedState


@pytest.fixture
def shared(tmp_path):
    return lambda name: str(tmp_path / name)


def drop(folder, name, content, age):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w" if isinstance(content, str) else "wb") as f:
        f.write(content)
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def test_manifests_are_handled_once_and_bad_ones_set_aside(spark, shared):
    folder, log, done = shared("in"), shared("log"), []
    good = {"file_path": "/x/a.csv", "file_type": "csv", "table_name": "a"}
    drop(folder, "b.json", json.dumps({**good, "file_size": 5}), 0)
    drop(folder, "a.json", json.dumps(good), 0)
    drop(folder, "c.json", "{broken", 0)
    drop(folder, "d.json", json.dumps({"file_path": "x", "file_type": "csv"}), 0)
    drop(folder, "e.json", "[1, 2]", 0)
    drop(folder, "f.json", json.dumps({**good, "table_name": "boom"}), 0)
    drop(folder, "a.json.processed", "", 0)

    def load(manifest):
        if manifest["table_name"] == "boom":
            raise RuntimeError("no such table")
        done.append((manifest["manifest"], manifest["file_size"]))

    run = lambda: manifests.process_manifests(manifests.manifest_stream(spark, folder), load, log, shared("ckpt"))
    run()
    assert done == [("a.json", None), ("b.json", 5)]
    drop(folder, "g.json", json.dumps(good), 5)
    run()
    assert done[2:] == [("g.json", None)]
    got = {r.manifest: (r.status, r.reason) for r in batches.read_batches(spark, log, manifests.LOADED_SCHEMA).collect()}
    assert got == {
        "a.json": ("processed", None),
        "b.json": ("processed", None),
        "c.json": ("failed", "invalid JSON"),
        "d.json": ("failed", "missing field: table_name"),
        "e.json": ("failed", "invalid JSON"),
        "f.json": ("failed", "load failed: no such table"),
        "g.json": ("processed", None),
    }


def stage(spark, folder, rows, schema, age):
    """One parquet file with a set age, so that the stream sees files in order."""
    target = f"{folder}-{age}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(target)
    part = next(f for f in os.listdir(target) if f.endswith(".parquet"))
    with open(os.path.join(target, part), "rb") as f:
        drop(folder, f"{age}.parquet", f.read(), age)


def test_upsert_keeps_the_last_of_equal_versions(spark, shared, rows):
    schema = "k INT, ver INT, v STRING"
    folder = shared("in")
    stage(spark, folder, [(1, 1, "a"), (2, 1, "b")], schema, 1)
    stage(spark, folder, [(1, 1, "c"), (3, 1, "d")], schema, 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    upsert.append_stream(stream, shared("t"), shared("ckpt"))
    table = upsert.versioned(spark, shared("t"), schema, ["k"], "ver")
    want = [(1, "c"), (2, "b"), (3, "d")]
    assert rows(table.read().select("k", "v")) == want
    # The same batch written again replaces itself.
    batches.write_batch(spark.createDataFrame([(1, 1, "c", 0), (3, 1, "d", 1)], f"{schema}, ingest_seq BIGINT"), shared("t"), 1)
    again = upsert.versioned(spark, shared("t"), schema, ["k"], "ver")
    assert again.df.count() == 4 and rows(again.read().select("k", "v")) == want
    upsert.compact(again, shared("compact"))
    assert spark.read.parquet(shared("compact")).count() == 3


def test_sequence_continues_and_survives_a_rerun(spark, shared, rows):
    schema = "session_id STRING, at INT"
    folder, out = shared("in"), shared("out")
    stage(spark, folder, [("a", i) for i in range(50)] + [("b", 1)], schema, 1)
    stage(spark, folder, [("a", i) for i in range(50, 60)] + [("c", 7), ("c", 5)], schema, 2)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = lambda: sequence.number_stream(stream(), F.col("at"), F.floor(F.col("at") / 8), out, shared("ckpt"))
    run()
    read = lambda: rows(batches.read_batches(spark, f"{out}/events", f"{schema}, num_order BIGINT").select("session_id", "at", "num_order"))
    want = sorted([("a", i, i + 1) for i in range(60)] + [("b", 1, 1), ("c", 5, 1), ("c", 7, 2)])
    assert read() == want
    os.remove(os.path.join(shared("ckpt"), "commits", "1"))  # as if the job died before the commit
    crc = os.path.join(shared("ckpt"), "commits", ".1.crc")
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert read() == want


def test_last_row_inserted_wins_inside_a_batch(spark, shared, rows):
    """Equal versions in one batch: the later file, and in a file the later row, whatever their values hash to."""
    schema, folder = "k INT, ver INT, v STRING", shared("in")
    stage(spark, folder, [(k, 1, f"old {k}") for k in range(30)] + [(k, 1, f"first {k}") for k in range(30)], schema, 2)
    stage(spark, folder, [(k, 1, f"{name} {k}") for name in "abcd" for k in range(20)], schema, 5)
    stream = spark.readStream.schema(schema).parquet(folder)
    upsert.append_stream(stream, shared("t"), shared("ckpt"))
    got = {r.k: r.v for r in upsert.versioned(spark, shared("t"), schema, ["k"], "ver").read().collect()}
    assert got == {k: f"d {k}" if k < 20 else f"first {k}" for k in range(30)}


def test_state_of_a_batch_follows_the_batch(spark, shared):
    """Parts merge like a binary counter: few are read, rows are written again log2(batches) times at most."""
    schema, written = "k INT, v INT", []
    state = KeyedState(spark, shared("s"), schema, ["k"])
    want = {}
    for batch in range(24):
        changed = [(batch * 3 + i, batch) for i in range(3)] + [(0, batch), (None, batch)] * (batch > 0)
        state.clean(batch)
        assert {r.k: r.v for r in state.read(batch).collect()} == want
        for _ in range(1 + batch % 2):  # a batch may run again
            state.write(spark.createDataFrame(changed, schema), batch)
        want.update(dict(changed))
        written.append(spark.read.parquet(state._folder((min(r[0] for r in state.parts() if r[1] == batch), batch))).count())
        assert len(state.parts()) <= 12
    state.clean(24)
    assert len(state.parts()) <= 5
    assert sum(written) <= 5 * 24 * 5 and sorted(written)[len(written) // 2] <= 12
    # Folders of a broken write are not believed.
    os.makedirs(f"{shared('s')}/part=24_24")
    assert {r.k: r.v for r in state.read(25).collect()} == want


def test_state_forgets_what_is_not_kept(spark, shared):
    state = KeyedState(spark, shared("s"), "k INT, day INT", ["k"], keep=F.col("day") >= 3)
    for batch in range(8):
        state.write(spark.createDataFrame([(batch, batch)], "k INT, day INT"), batch)
    state.clean(8)
    assert sorted(r.k for r in state.read(8).collect()) == [3, 4, 5, 6, 7]


def test_scan_stream_records_files_that_are_too_large(spark, shared):
    root, out = shared("docs"), shared("catalog")
    drop(root, "a.txt", "alpha", 1)
    drop(root, "big.txt", "x" * 5000, 1)
    drop(root, "bigger.txt", "x" * 6000, 1)
    run = lambda: documents.scan_stream(documents.document_stream(spark, root, max_bytes=1000), out, shared("ckpt"))
    run()
    drop(root, "b.txt", "beta", 2)
    run()
    current = {r.file_name: (r.decision, r.process_status) for r in documents.catalog(spark, out).collect()}
    assert current == {"a.txt": ("processed", "ready"), "b.txt": ("processed", "ready"), "big.txt": ("failed", "failed"), "bigger.txt": ("failed", "failed")}
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:  # what Spark itself refuses to read does not stop the stream
        documents.scan_stream(documents.document_stream(spark, root), shared("other"), shared("other-ckpt"))
        assert documents.catalog(spark, shared("other")).filter("decision = 'failed'").count() == 2
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


LONG_FILES = {
    "ends.txt": b"one\ntwo two\n\nthree\n" * 9,
    "open.txt": b"one\r\ntwo\rtwo\n" * 9 + b"no line end",
    "marked.txt": b"\xef\xbb\xbfmark\n" * 9,
    "marked-open.txt": b"\xef\xbb\xbfmark\n" * 9 + b"x",
    "bytes.pdf": bytes(range(256)) * 3,
    "one-line.txt": b"y" * 300,
    "breaks.txt": b"\n" * 99,
    "a b%20[x]{y}?*,#\u00e9\\.txt": b"odd name\n" * 9,
}


def test_long_files_are_hashed_in_parts(spark, shared):
    root, out = shared("docs"), shared("catalog")
    hashes = {}
    for folder, project, more in (("lang=de", 0, b""), ("b", 0, b""), ("project_7/c", 7, b"seven")):  # some look like partitions
        for name, content in LONG_FILES.items():
            drop(f"{root}/{folder}", name, content + more, 1)
            hashes[project, name] = hashlib.sha256(content + more).hexdigest()
    drop(root, "short.txt", "short", 1)
    drop(root, "huge.txt", "z" * 2000, 1)
    stream = documents.document_stream(spark, root, max_bytes=1000, whole_bytes=20)
    settings = {"spark.sql.sources.binaryFile.maxLength": "20", "spark.sql.files.maxPartitionBytes": "64"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:  # Spark now refuses to read a long file whole
        documents.scan_stream(stream, out, shared("ckpt"))
        drop(f"{root}/again", "open2.txt", LONG_FILES["open.txt"], 5)
        documents.scan_stream(stream, out, shared("ckpt"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    rows = batches.read_batches(spark, out, documents.CATALOG_SCHEMA).collect()
    got = sorted((r.batch_id, r.project_id, r.file_hash or "", r.decision, r.process_status) for r in rows)
    read = {(project, h): ("processed", "ready") for (project, _), h in hashes.items()}
    read |= {(0, hashlib.sha256(b"short").hexdigest()): ("processed", "ready"), (0, ""): ("failed", "failed")}
    again = (1, 0, hashes[0, "open.txt"], "skipped", None)
    assert got == sorted([(0, *key, *what) for key, what in read.items()] + [again])


def test_contents_of_long_files_reach_ingest(spark, shared):
    root, out, seen = shared("docs"), shared("catalog"), []
    drop(root, "packed.txt.gz", b"not really packed\n" * 9, 1)
    drop(root, "long.txt", LONG_FILES["open.txt"], 1)
    drop(root, "short.txt", "short", 1)

    def ingest(todo):
        seen.append((sorted(todo.columns), {r.path: bytes(r.content) for r in todo.collect()}))
        return todo.select("file_hash", F.lit("ready").alias("status"))

    documents.scan_stream(documents.document_stream(spark, root, whole_bytes=20), out, shared("ckpt"), ingest)
    assert len(seen) == 1 and seen[0][1] == {"long.txt": LONG_FILES["open.txt"], "short.txt": b"short"}
    assert seen[0][0] == sorted(["project_id", "file_hash", "path", "file_name", "file_type", "file_bytes", "decision", "content"])
    entries = {r.path: (r.file_hash, r.decision) for r in documents.catalog(spark, out).collect()}
    assert entries["packed.txt.gz"] == (hashlib.sha256(b"not really packed\n" * 9).hexdigest(), "failed")


def test_blocks_of_long_files_give_the_hash_of_the_file(monkeypatch):
    monkeypatch.setattr(document_files, "BLOCK_BYTES", 7)
    contents = [b"alpha\nbeta\n\ngamma delta\n", b"\xef\xbb\xbfmarked\nopen"]
    lines = [("u0", 0, b"alpha"), ("u0", 0, b"beta"), ("u0", 9, b""), ("u0", 9, b"gamma delta"), ("u1", 0, b"marked"), ("u1", 0, b"open")]
    read = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["at", "start", "line"]) for part in (lines[:3], lines[3:])]
    blocks = list(document_files._packed(iter(read), {"u0": 0, "u1": 1}))
    assert [b["size"].to_pylist() for b in blocks] == [[11], [13], [7], [5]]
    hashed = [tuple(r.values()) for b in document_files._hashed(iter(blocks), [len(c) for c in contents]) for r in b.to_pylist()]
    assert hashed == [(n, hashlib.sha256(c).hexdigest()) for n, c in enumerate(contents)]
    with pytest.raises(ValueError, match="was read as"):
        list(document_files._hashed(iter(blocks[:1]), [len(contents[0])]))


def test_late_ticks_are_dropped_and_open_windows_wait(spark, shared, rows):
    schema = "symbol STRING, time TIMESTAMP_NTZ, price DOUBLE, volume BIGINT"
    ts = lambda text: __import__("datetime").datetime.fromisoformat(f"2024-01-01 {text}")
    folder = shared("in")
    stage(spark, folder, [("A", ts("09:00:10"), 5.0, 1), ("A", ts("09:00:50"), 7.0, 2), ("A", ts("10:30:00"), 9.0, 1)], schema, 1)
    stage(spark, folder, [("A", ts("10:30:30"), 4.0, 1)], schema, 2)
    # Rows are judged by the watermark of the batch before theirs.
    stage(spark, folder, [("A", ts("09:00:20"), 99.0, 1), ("A", ts("11:45:00"), 1.0, 1)], schema, 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    bars.write_bars(bars.bar_stream(stream), shared("bars"), shared("ckpt"))
    got = spark.read.parquet(shared("bars")).select("symbol", F.date_format("time", "HH:mm"), "open", "high", "low", "close", "volume")
    assert rows(got) == [("A", "09:00", 5.0, 7.0, 5.0, 7.0, 3), ("A", "10:30", 9.0, 9.0, 4.0, 4.0, 2)]


def test_scan_stream_skips_retries_and_fails(spark, shared):
    root, out = shared("docs"), shared("catalog")
    drop(root, "a.txt", "alpha", 1)
    drop(root, "copy.txt", "alpha", 1)
    drop(root, "b.txt", "beta", 1)
    drop(root, "c.exe", "gamma", 1)
    drop(root, ".hidden.txt", "x", 1)

    def ingest(todo):
        return todo.select("file_hash", F.when(F.col("file_name").startswith("b"), "failed").otherwise("ready").alias("status"))

    run = lambda force=False: documents.scan_stream(documents.document_stream(spark, root), out, shared("ckpt"), ingest, force)
    run()
    entries = lambda n: {
        r.path: (r.decision, r.process_status) for r in batches.read_batches(spark, out, documents.CATALOG_SCHEMA).filter(f"batch_id = {n}").collect()
    }
    assert entries(0) == {"a.txt": ("processed", "ready"), "b.txt": ("processed", "failed"), "c.exe": ("failed", "failed")}
    drop(root, "a2.txt", "alpha", 2)
    drop(root, "b2.txt", "beta", 2)
    run()
    assert entries(1) == {"a2.txt": ("skipped", None), "b2.txt": ("retried", "failed")}
    current = {r.file_name: r.process_status for r in documents.catalog(spark, out).collect()}
    assert current == {"a.txt": "ready", "b2.txt": "failed", "c.exe": "failed"}
    drop(root, "a3.txt", "alpha", 3)
    run(force=True)
    assert entries(2) == {"a3.txt": ("retried", "ready")}


def test_first_uploads_within_a_time_span(spark, shared, rows):
    schema = "project_id INT, file_hash STRING, uploaded_at TIMESTAMP"
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    folder = shared("in")
    stage(spark, folder, [(1, "x", day(1)), (1, "x", day(1)), (2, "x", day(1))], schema, 1)
    stage(spark, folder, [(1, "x", day(2)), (1, "y", day(9))], schema, 2)
    stage(spark, folder, [(1, "y", day(9))], schema, 3)  # state is dropped at the end of a batch
    stage(spark, folder, [(1, "x", day(10))], schema, 4)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def run(fresh, name):
        batches.run_batches(fresh, lambda r, n: batches.write_batch(r, shared(name), n), shared(f"{name}-ckpt"))
        return rows(batches.read_batches(spark, shared(name), schema).select("project_id", "file_hash", F.dayofmonth("uploaded_at")))

    assert run(documents.first_uploads(stream(), None), "ever") == [(1, "x", 1), (1, "y", 9), (2, "x", 1)]
    assert run(documents.first_uploads(stream(), "3 days"), "span") == [(1, "x", 1), (1, "x", 10), (1, "y", 9), (2, "x", 1)]


def test_versions_of_a_stream_are_sorted_after_the_shuffle_only(spark, shared, rows):
    path, schema = shared("many"), "k INT, ver INT, v STRING"
    for batch in range(6):
        new = spark.createDataFrame([(k, batch if k % 3 else 0, f"{batch}") for k in range(40)] + [(None, batch, f"n{batch}")], schema)
        batches.write_batch(new.select("*", F.lit(None).cast(upsert.ORIGIN_TYPE).alias(upsert.ORIGIN), F.xxhash64("k").alias(upsert.SEQUENCE)).coalesce(1), path, batch)
    table = upsert.versioned(spark, path, schema, ["k"], "ver")
    assert table.partitions == 2 * table.df.rdd.getNumPartitions()
    for fewer, more in (("4", 9), ("200", 200)):
        spark.conf.set("spark.sql.shuffle.partitions", fewer)
        try:
            latest = dataclasses.replace(table, partitions=9).read()
            plan = latest._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and f", {more})" in plan
            below = plan[plan.index("Exchange hashpartitioning") :]
            assert "Sort [" not in below and "WindowGroupLimit" not in below
            assert sorted(latest.select(F.coalesce("k", F.lit(-1)), "v").collect()) == [(-1, "n5"), *((k, "5") for k in range(40))]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert table.read(final=False).count() == 6 * 41
    assert sorted(r.v for r in table.read().collect()) == ["5"] * 40 + ["n5"]
