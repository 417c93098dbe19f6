import gzip
import hashlib

import pyarrow.fs
import pytest

from quarry.llm import warc

SCHEMA = "id long, url string, payload binary"
ROWS = [
    (1, "http://a/x y", b"q" * 2000), (2, "http://b", b"q" * 2000), (5, None, b"q" * 2000), (5, "http://c", b"q" * 2000),
    (7, "u", None), (None, "n", b"z" * 1500), (8, "http://b/2", b"z" * 1500), (9, "http://k", b"a\r\n\r\nb" * 10),
    (9, "http://k", b"a\r\n\r\nb" * 10), (10, "http://w", b"w" * 999), (11, "http://w", b"w" * 999), (None, "m", b"y" * 1200), (None, "m", b"y" * 1200),
]


def expected(rows):
    best = {}
    for id_, _, payload in rows:
        if len(payload or b"") >= 1000 and id_ is not None:
            best[payload] = max(best.get(payload, id_), id_)
    out = []
    for id_, _, payload in rows:
        winner = best.get(payload)
        revisit = winner is not None and id_ != winner
        size, digest = len(payload or b""), hashlib.sha1(payload or b"").hexdigest()
        out.append((str(id_), size, digest, "revisit" if revisit else "response", str(winner) if revisit else None))
    return sorted(map(str, out))


def read_back(index):
    rows = warc.read_records(index).collect()
    return sorted(str((str(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows)


@pytest.mark.parametrize("archive_bytes", [1, 700, 1 << 30])
def test_round_trip(spark, archive_bytes):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), archive_bytes)
    assert read_back(index) == expected(ROWS)
    payloads = {(r["record_id"], bytes(r["payload"])) for r in warc.read_records(index).collect() if r["record_type"] == "response"}
    assert payloads == {(r, b) for r, b in ((str(i) if i is not None else None, p or b"") for i, _, p in ROWS) if (r, b) not in {("1", b"q" * 2000), ("2", b"q" * 2000), (None, b"z" * 1500)}}


def test_scanning_gives_the_same_index(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), 900)
    columns = ["archive", "offset", "length", "record_type", "record_id", "refers_to", "payload_digest", "payload_bytes"]
    again = warc.index_archives(warc.archives(index))
    assert sorted(map(str, again.select(*columns).collect())) == sorted(map(str, index.select(*columns).collect()))


def test_plain_archives_are_read(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA))
    paths = []
    for k, row in enumerate(warc.archives(index).collect()):
        files, inside = pyarrow.fs.FileSystem.from_uri(row["path"])
        with files.open_input_stream(inside, compression=None) as source:
            (tmp_path / f"{k}.warc").write_bytes(gzip.decompress(source.read()))
        paths.append(str(tmp_path / f"{k}.warc"))
    assert read_back(warc.index_archives(warc.paths_frame(spark, paths))) == expected(ROWS)


def test_selection_reads_only_chosen_records(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(r["record_id"] for r in warc.read_records(warc.by_url(index, "http://b")).collect()) == ["2", "8"]


def test_neighbours_are_read_together():
    rows = [{"archive": a, "offset": o, "length": 10} for a, o in (("x", 0), ("x", 10), ("x", 30), ("x", 500), ("y", 0))]
    assert [len(p) for p in warc.ranges(iter(rows), 20, 100)] == [3, 1, 1]
    assert [len(p) for p in warc.ranges(iter(rows), 1000, 25)] == [2, 1, 1, 1]


def test_damaged_record_raises():
    raw = warc.record_bytes("response", "1", None, "u", b"abcdef").replace(b"abcdef", b"abcdeX")
    with pytest.raises(ValueError):
        warc.parse_record(raw)


def test_empty_table(spark):
    index = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert warc.read_records(index).count() == 0
