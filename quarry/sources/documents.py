"""Document folders: recursive scan, content hash, text decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import file_extension

# Folders that hold data of other jobs.
SKIPPED_FOLDERS = ("OLAP", "checkpoint", "_ingestion_log", "logs", "tmp")

PLAIN_TEXT = ("txt", "md")

# Files above this size are hashed from parts that several tasks read, in packed blocks of about this size.
WHOLE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


class DocParser(Protocol):
    """Turns file bytes into text inside the tasks; one per file type."""

    def load(self) -> None: ...

    def parse(self, content: bytes) -> str: ...


def decode_text(content: Column) -> Column:
    """UTF-8 if valid, else Latin-1, which accepts every byte. A byte order mark stays."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def visible_files(files: DataFrame, root: str, *more: Column) -> DataFrame:
    """Drop hidden files and files below hidden or skipped folders; add name, type, hash, and further columns."""
    inside = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    relative = F.substring(inside, F.lit(len(base) + 1), F.length(inside))
    parts = F.split(relative, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    skipped = F.exists(folders, lambda p: p.isin(*SKIPPED_FOLDERS))
    return files.filter(~hidden & ~skipped).select(
        relative.alias("path"),
        name.alias("file_name"),
        file_extension(name).alias("file_type"),
        F.sha2("content", 256).alias("file_hash"),
        F.col("length").alias("file_bytes"),
        "content",
        *more,
    )


def size_limit(spark: SparkSession, max_bytes: int | None) -> int:
    """Bytes of the largest file that is read: what fits into a row, or less if asked."""
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    return limit if max_bytes is None else min(limit, max_bytes)


def named_files(spark: SparkSession, uris: Sequence[str]) -> DataFrame:
    """(uri, at, length, content): the named files; `at` is the name under which Spark tells parts of a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_literal(uris))
    return files.select(F.col("path").alias("uri"), F.col("_metadata.file_path").alias("at"), "length", "content")


def long_hashes(spark: SparkSession, uris: Sequence[str]) -> DataFrame:
    """(uri, file_hash): SHA-256 of long files, each read in parts by several tasks.

    These pack the lines of their parts. A task per file then takes the packed blocks in order and holds some of them at a time;
    only a line is held whole. Files that Spark would unpack by their name are read whole. A file that is not as long as it is
    listed when it is read is refused. Lists the files while it is called.
    """
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(context._jsc.hadoopConfiguration())
    plain = [u for u in uris if codecs.getCodec(hadoop.fs.Path(u)) is None]
    hashes = spark.createDataFrame([], "uri STRING, file_hash STRING")
    if len(plain) < len(uris):
        packed = named_files(spark, [u for u in uris if u not in plain])
        hashes = hashes.unionByName(packed.select("uri", F.sha2("content", 256).alias("file_hash")))
    if plain:
        listed = named_files(spark, plain).select("uri", "at", "length").collect()
        number = {r["at"]: n for n, r in enumerate(listed)}
        length = [r["length"] for r in listed]
        lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(_literal(plain))
        part = F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("start")
        blocks = lines.select(*part, F.col("value").cast("binary").alias("line")).mapInArrow(
            lambda batches: _packed(batches, number), "file INT, start LONG, place INT, size LONG, packed BINARY"
        )
        # Each file has a task of its own.
        ordered = blocks.repartitionById(len(listed), "file").sortWithinPartitions("file", "start", "place")
        found = ordered.mapInArrow(lambda batches: _hashed(batches, length), "file INT, file_hash STRING")
        names = spark.createDataFrame([(n, r["uri"]) for n, r in enumerate(listed)], "file INT, uri STRING")
        hashes = hashes.unionByName(found.join(F.broadcast(names), "file").select("uri", "file_hash"))
    return hashes


def _literal(paths: Sequence[str]) -> list[str]:
    """Paths as patterns that match only themselves."""
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]


def _packed(batches: Iterator[pa.RecordBatch], number: Mapping[str, int]) -> Iterator[pa.RecordBatch]:
    """The lines of parts of files, each with a line end, as packed blocks that are numbered in order."""
    codec, part, held, size, place = pa.Codec("zstd", 3), None, [], 0, 0
    names = ["file", "start", "place", "size", "packed"]

    def block() -> pa.RecordBatch:
        columns = [number[part[0]]], [part[1]], [place], [size], [codec.compress(b"".join(held), asbytes=True)]
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        for at, start, line in zip(*(c.to_pylist() for c in batch.columns)):
            if held and ((at, start) != part or size >= BLOCK_BYTES):
                yield block()
                held, size, place = [], 0, place + 1
            part = (at, start)
            held += (line, b"\n")
            size += len(line) + 1
    if held:
        yield block()


def _hashed(batches: Iterator[pa.RecordBatch], length: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The hash of each file, whose packed blocks stream by in order.

    Reading by lines drops a byte order mark, and does not tell whether the last line has an end; the length of the file tells both.
    """
    codec, now, size, last = pa.Codec("zstd", 3), None, 0, b""
    with_mark, without = hashlib.sha256(), hashlib.sha256()

    def result() -> pa.RecordBatch:
        more = length[now] - size
        if more not in (-1, 0, 2, 3):
            raise ValueError(f"a file of {length[now]} bytes was read as {size} bytes with line ends")
        digest = with_mark if more >= 2 else without
        if more in (0, 3):
            digest.update(last)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([digest.hexdigest()])], names=["file", "file_hash"])

    for batch in batches:
        for file, n, packed in zip(*(batch[c].to_pylist() for c in ("file", "size", "packed"))):
            if file != now:
                if now is not None:
                    yield result()
                now, size, last = file, 0, b""
                with_mark, without = hashlib.sha256(BYTE_ORDER_MARK), hashlib.sha256()
            text = codec.decompress(packed, n, asbytes=True)
            for digest in (with_mark, without):
                digest.update(last)
                digest.update(memoryview(text)[:-1])
            size, last = size + n, text[-1:]
    if now is not None:
        yield result()


def scan_documents(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """All visible files below a folder, one row each.

    The size is judged before anything is read: larger files, and those that do not fit
    into a row, are listed without content and hash.
    """
    limit = size_limit(spark, max_bytes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    large = files.filter(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return visible_files(files.filter(F.col("length") <= limit).select("path", "length", "content").unionByName(large), root)


def parse_documents(files: DataFrame, parsers: Mapping[str, DocParser] | None = None) -> DataFrame:
    """Add `text`: plain text is decoded natively, other types by the given parsers."""
    text = F.when(F.col("file_type").isin(*PLAIN_TEXT), decode_text(F.col("content")))
    for kind, parser in (parsers or {}).items():
        text = text.when(F.col("file_type") == kind, _parse_column(parser, kind))
    return files.withColumn("text", text)


def _parse_column(parser: DocParser, kind: str) -> Column:
    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parser.load()
        for contents in batches:
            yield contents.map(lambda c: None if c is None else parser.parse(bytes(c)))

    # UDF arguments are evaluated for all rows, so other types are blanked first.
    return parse(F.when(F.col("file_type") == kind, F.col("content")))
