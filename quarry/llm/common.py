"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import configure, scratch_path

# Texts handed to a Python worker at once; a single longer text comes alone.
BATCH_BYTES = 8 << 20
# Texts above this are taken word by word instead of as a list of all their words.
LONG_BYTES = 4 << 20
# Written tables may hold rows of several megabytes; readers take a row group at a time.
ROW_GROUP_BYTES = 32 << 20
# Rows of a counted lookup table that may be sent to every executor.
BROADCAST_ROWS = 500_000


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_in(raw: bytes) -> Iterable[bytes]:
    """Runs of bytes between ASCII white space: a list, or for a long text an iterator."""
    return raw.split() if len(raw) <= LONG_BYTES else (m.group() for m in _WORD.finditer(raw))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and Arrow batches bounded in bytes."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: computed once, free of lineage.

    Parquet looks at the size of a row group after 100 rows only; `group_rows` ends it earlier, for rows of megabytes.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Does crc32 of the id's text leave this remainder? A null id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it has few rows when counted, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of the frame is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that name a row by its id and its text, so that ids may repeat."""
    return [doc_id.alias("doc_id"), F.xxhash64(text, F.length(text)).alias("text_hash")]


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `docs` whose id and text are not among `keys` (of `text_key`), columns unchanged."""
    key_id, key_hash = free_name(docs, "key_id"), free_name(docs, "key_hash")
    keys = small(keys.select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash)).distinct())
    id_, hash_ = text_key(F.col("doc_id"), F.col("text"))
    return docs.join(keys, F.col(key_id).eqNullSafe(id_) & (F.col(key_hash) == hash_), "left_anti")
