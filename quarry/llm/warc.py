"""WARC archives: index first, then coalesced byte-range reads.

`write_archives` lets every task write archives of its own to the shared folder, one
gzip member per record, and returns the index: archive, offset, length, URL, digest
and the other headers of each record. The index is written once and is the
only way to the records, so files left by a lost or repeated task attempt, which
have names of their own, are never read. `index_archives` makes the same index of
archives that were written elsewhere, plain or gzipped.

`read_records` takes any selection of index rows, sorts them by archive and offset
and joins neighbours that are at most `GAP_BYTES` apart to one read of at most
`RANGE_BYTES` (a longer record is read alone). Payload digests are verified.

Payloads of at least `REVISIT_BYTES` that occur more than once are stored once, in the
record with the largest id; the others become revisit records. Headers hold the
digest and, in an extension field, the length of the full payload.

Defined results: a null payload is empty. A null URL gives a record without a target.
Rows that repeat the largest id are all responses. If no row of equal payloads has an
id, all are responses. Control characters and blanks in URLs are percent-encoded in
the header, the index keeps the URL as it was. Very long payloads are written and read whole, one at
a time. An empty table writes no archive and has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small, stored
from quarry.session import scratch_path

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
GAP_BYTES = 64 << 10
RANGE_BYTES = 4 << 20
TASK_BYTES = 8 << 20
READ_BYTES = 1 << 20
LEVEL = 1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "archive string, offset long, length long, record_type string, record_id string, refers_to string, url string, "
    "payload_digest string, payload_bytes long"
)
INDEX_ARROW = pa.schema(
    [
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
        ("refers_to", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ]
)
RECORDS = "record_id string, record_type string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary"
RECORDS_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ]
)


def header_url(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record_bytes(record_type: str, record_id: str | None, refers_to: str | None, url: str | None, payload: bytes) -> bytes:
    """One whole record, not compressed."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<urn:record:{record_id or ''}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", header_url(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    block = b""
    if record_type == "revisit":
        fields += [("WARC-Refers-To", f"<urn:record:{refers_to or ''}>"), ("WARC-Profile", PROFILE)]
    else:
        fields.append(("Content-Type", "application/http; msgtype=response"))
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the block starts."""
    end = raw.index(b"\r\n\r\n") + 4
    lines = raw[: end - 4].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end


def name_in(urn: str | None) -> str | None:
    return (urn or "").strip("<>").removeprefix("urn:record:") or None


def hex_digest(value: str | None) -> str | None:
    """Lower-case hex of a `sha1:` digest in base 32."""
    return base64.b32decode(value.removeprefix("sha1:")).hex() if value and value.startswith("sha1:") else None


def parse_record(raw: bytes) -> dict:
    """A record with its payload; a payload that does not fit its digest raises."""
    head, start = parse_head(raw)
    block = raw[start : start + int(head["content-length"])]
    kind, digest = head["warc-type"], hex_digest(head.get("warc-payload-digest"))
    payload = None
    if kind != "revisit":
        payload = block[block.index(b"\r\n\r\n") + 4 :] if head.get("content-type", "").startswith("application/http") else block
        if digest not in (None, hashlib.sha1(payload).hexdigest()):
            raise ValueError(f"damaged record {head.get('warc-record-id')}")
    size = head.get("x-payload-length")
    return {
        "record_id": name_in(head.get("warc-record-id")), "record_type": kind, "refers_to": name_in(head.get("warc-refers-to")),
        "url": head.get("warc-target-uri"), "payload_digest": digest if payload is None else hashlib.sha1(payload).hexdigest(),
        "payload_bytes": len(payload) if payload is not None else int(size) if size else None, "payload": payload,
    }


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def open_path(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def write_task(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    files, inside = open_path(folder)
    files.create_dir(inside, recursive=True)
    out, archive, at = None, "", 0
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if out is None or at >= archive_bytes:
                if out is not None:
                    out.close()
                name = f"{uuid.uuid4().hex}.warc.gz"
                out, archive, at = files.open_output_stream(f"{inside}/{name}", compression=None), f"{folder}/{name}", 0
            payload = row.pop("payload") or b""
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            raw = record_bytes(row["record_type"], row["record_id"], row["refers_to"], row["url"], payload)
            member = packer.compress(raw) + packer.flush()
            out.write(member)
            rows.append(row | {"archive": archive, "offset": at, "length": len(member)})
            at += len(member)
        yield as_batch(rows, INDEX_ARROW)
    if out is not None:
        out.close()


def with_roles(records: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """`records` (id long, url, payload binary) as rows of an index to be, with the payload.

    Equal payloads are told by SHA-1 and length. Only groups of two or more are looked
    up, by broadcast when they are few, so payloads are shuffled only when they are many.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = records.select("id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = rows.filter(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest", "payload_bytes")
    winners = stored(groups.agg(F.max("id").alias("winner"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-winners")
    rows = rows.join(small(winners), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("id").cast("string").alias("record_id"),
        F.when(revisit, F.col("winner")).cast("string").alias("refers_to"), "url", "payload_digest", "payload_bytes", "payload",
    )


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write `records` (id, url, payload) as archives in the shared folder; returns the written index."""
    folder = scratch_path(records.sparkSession, "warc")
    rows = with_roles(records, revisit_bytes)
    return stored(rows.mapInArrow(lambda batches: write_task(batches, folder, archive_bytes), INDEX), "warc-index")


def scan_archive(path: str) -> Iterator[dict]:
    """Index rows of one archive, read from start to end in portions."""
    files, inside = open_path(path)
    with files.open_input_stream(inside, compression=None) as source:
        gzipped, data, at = None, b"", 0
        while True:
            if len(data) < READ_BYTES:
                data += source.read(READ_BYTES)
            if not data:
                return
            gzipped = data[:2] == b"\x1f\x8b" if gzipped is None else gzipped
            if gzipped:
                unpacker, raw, length = zlib.decompressobj(31), b"", 0
                while not unpacker.eof:
                    raw += unpacker.decompress(data)
                    length += len(data) - len(unpacker.unused_data)
                    data = unpacker.unused_data if unpacker.eof else source.read(READ_BYTES)
                    if not data and not unpacker.eof:
                        raise ValueError(f"{path} ends inside a record")
            else:
                while b"\r\n\r\n" not in data:
                    more = source.read(READ_BYTES)
                    if not more:
                        raise ValueError(f"{path} ends inside a record")
                    data += more
                head, start = parse_head(data)
                length = start + int(head["content-length"]) + 4
                while len(data) < length:
                    more = source.read(max(READ_BYTES, length - len(data)))
                    if not more:
                        raise ValueError(f"{path} ends inside a record")
                    data += more
                raw, data = data[:length], data[length:]
            row = parse_record(raw)
            row.pop("payload")
            yield row | {"archive": path, "offset": at, "length": length}
            at += length


def index_archives(paths: DataFrame) -> DataFrame:
    """Index of existing archives, named by the column `path`; one task reads an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in scan_archive(path):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield as_batch(rows, INDEX_ARROW)
                        rows = []
                yield as_batch(rows, INDEX_ARROW)

    return stored(paths.select(F.col("path").cast("string")).mapInArrow(run, INDEX), "warc-index")


def ranges(rows: Iterator[dict], gap_bytes: int, range_bytes: int) -> Iterator[list[dict]]:
    """Neighbours in sorted order that are read together."""
    part: list[dict] = []
    for row in rows:
        if part:
            last, first = part[-1], part[0]
            far = row["archive"] != last["archive"] or row["offset"] - last["offset"] - last["length"] > gap_bytes
            if far or row["offset"] + row["length"] - first["offset"] > range_bytes:
                yield part
                part = []
        part.append(row)
    if part:
        yield part


def read_task(batches: Iterator[pa.RecordBatch], gap_bytes: int, range_bytes: int, with_payload: bool) -> Iterator[pa.RecordBatch]:
    path, source = None, None
    for part in ranges((row for batch in batches for row in batch.to_pylist()), gap_bytes, range_bytes):
        if part[0]["archive"] != path:
            if source is not None:
                source.close()
            path = part[0]["archive"]
            files, inside = open_path(path)
            source = files.open_input_file(inside)
        start = part[0]["offset"]
        data = source.read_at(max(r["offset"] + r["length"] for r in part) - start, start)
        rows = []
        for row in part:
            member = data[row["offset"] - start : row["offset"] - start + row["length"]]
            record = parse_record(zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member)
            rows.append(record | ({} if with_payload else {"payload": None}))
        yield as_batch(rows, RECORDS_ARROW)
    if source is not None:
        source.close()


def read_records(index: DataFrame, with_payload: bool = True, gap_bytes: int = GAP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records behind the given index rows, each once per row, in tasks of about `TASK_BYTES`.

    Stretches of `TASK_BYTES` of an archive go to one task, by a hash, so no sample of the index is gathered to deal them out.
    """
    rows = index.select("archive", "offset", "length")
    total = rows.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / TASK_BYTES)
    dealt = rows.repartition(1 + int(total) // TASK_BYTES, "archive", stretch).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(lambda batches: read_task(batches, gap_bytes, range_bytes, with_payload), RECORDS)


def archives(index: DataFrame) -> DataFrame:
    """The archives an index speaks of, as `path`."""
    return index.select(F.col("archive").alias("path")).distinct()


def page_records(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) as records to be archived."""
    return pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("payload"))


def by_url(index: DataFrame, prefix: str) -> DataFrame:
    """Index rows whose URL starts with `prefix`; archives are not touched."""
    return index.filter(F.startswith(F.col("url"), F.lit(prefix)))


def paths_frame(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Archive names as a frame with one task each."""
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
