"""Records of large text files that are read in parts by many tasks, and lie across the cuts between parts.

A reader gives pieces (file, block, place, row, record): whole records, and the parts of a record in front of, across and
behind the place where its file was cut.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECES = "file string, block long, place int, row long, record string"
WHOLE, OPENED, INSIDE, CLOSED = range(4)
# Parts of files that the driver may be told about, one small row each.
MAX_PARTS = 500_000


def delimited(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, value): text between separators, in order inside a part (file, block) of a file."""
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def told(parts: DataFrame) -> list:
    """Rows about parts of files on the driver, refused when there are too many."""
    found = parts.limit(MAX_PARTS + 1).collect()
    if len(found) > MAX_PARTS:
        raise ValueError(f"the files have more than {MAX_PARTS} parts to be told apart; read larger parts")
    return found


def as_pieces(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "place", "row", "record"])


def whole_records(pieces: DataFrame, separator: str, any_cut: bool = True) -> DataFrame:
    """(file, block, row, record): whole records, and those that were cut put together. Only the latter are shuffled."""
    records = pieces.filter(F.col("place") == WHOLE).select("file", "block", "row", "record")
    if not any_cut:
        return records
    # A record is opened in one part and closed in a later one, perhaps with whole parts in between.
    opened = F.col("place") == OPENED
    order = Window.partitionBy("file").orderBy("block", opened.cast("int"))
    numbered = pieces.filter(F.col("place") != WHOLE).withColumn("n", F.sum(opened.cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", opened.alias("at_end"), "row", "record")))
    joined = numbered.groupBy("file", "n").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), separator)
    first = F.get("parts", 0)
    return records.unionByName(joined.select("file", first["block"].alias("block"), first["row"].alias("row"), text.alias("record")))
