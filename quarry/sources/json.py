"""JSON lines and JSON case files."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.parts import CLOSED, INSIDE, OPENED, PIECES, WHOLE, as_pieces, delimited, told, whole_records

CORRUPT = "_corrupt_record"

LOG_SCHEMA = (
    "run_id STRING, test_id STRING, category STRING, session_id STRING, component STRING, ts_end STRING,"
    " input STRING, output STRING, traces STRING,"
    " usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, total_tokens: BIGINT, calls: BIGINT>,"
    " latency_ms BIGINT, error STRING"
)

CASE_SCHEMA = (
    "id STRING, question STRING, history ARRAY<STRUCT<role: STRING, content: STRING>>, category STRING,"
    " expected_tools ARRAY<STRING>, expected_entities ARRAY<STRING>, expected_timeframe STRING, scope STRING,"
    " style STRING, persona STRING, complexity STRING, needs_clarification BOOLEAN, reference_answer STRING,"
    " sources ARRAY<STRING>, key_facts ARRAY<STRING>, negative_facts ARRAY<STRING>, unanswerable BOOLEAN,"
    " expected_chart STRUCT<chart_type: ARRAY<STRING>, table: STRING, x_column: STRING, y_columns: ARRAY<STRING>,"
    " filters: MAP<STRING, STRING>, order_by: ARRAY<ARRAY<STRING>>>,"
    " expected_data_facts ARRAY<STRING>, expected_caption_facts ARRAY<STRING>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON-lines files; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_logs(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Log records with flat token counts, ready for the token statistics.

    `line` orders the records of one file as they stand in it: where the part of the
    file begins that a task has read, and the place of the record in that part.
    """
    logs = read_jsonl(spark, path, schema)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    kinds = ("input_tokens", "output_tokens", "total_tokens", "calls")
    return logs.select("*", F.col("_metadata.file_name").alias("file"), place.alias("line"), *[F.col(f"usage.{k}").alias(k) for k in kinds])


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines `read_jsonl` cannot read as an object, for reporting."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = F.from_json("value", "a STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.filter(parsed.isNull() | F.try_parse_json("value").isNull())


def read_cases(spark: SparkSession, path: str, schema: str = CASE_SCHEMA) -> DataFrame:
    """Test cases from files that hold an array, or an object with an array `items`."""
    case = T.StructType.fromDDL(schema)
    either = T.StructType([*case.fields, T.StructField("items", T.ArrayType(case))])
    raw = spark.read.schema(either).option("multiLine", True).json(path)
    own = F.array(F.struct(*case.names))
    rows = F.explode(F.when(F.col("items").isNotNull(), F.col("items")).otherwise(own))
    return raw.select(rows.alias("case")).select("case.*")


# Marks that tell where a value ends; what follows a backslash is none.
_MARK = re.compile(r'\\.|["{\[\]:]', re.DOTALL)
_PART = "file string, block long, top string, quoted_out boolean, moved_out long, quoted_in boolean, moved_in long"
_KEYS = "file string, block long, name string"


def _moved(text: str, quoted: bool) -> tuple[bool, int]:
    """Is a string open after a text that ends in front of a `}`, and how much deeper is it then, the `}` counted?"""
    depth = 0
    for mark in _MARK.finditer(text):
        sign = mark.group()
        if sign == '"':
            quoted = not quoted
        elif not quoted and sign in "[{":
            depth += 1
        elif not quoted and sign == "]":
            depth -= 1
    return quoted, depth - (not quoted)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every part of a file does to the depth, whether or not it begins inside a string."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, block, text in zip(*(c.to_pylist() for c in batch.columns)):
            state = found.setdefault((file, block), [text.lstrip("\ufeff \t\r\n")[:1] if block == 0 else None, False, 0, True, 0])
            for k in (1, 3):
                state[k], by = _moved(text, state[k])
                state[k + 1] += by
    columns = list(zip(*((*key, *state) for key, state in found.items()))) or [[]] * 7
    types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _PART.split(", ")])


class _Walker:
    """Follows the elements of the wanted array along the text of one part."""

    def __init__(self, top: str, quoted: bool, depth: int, name: str | None):
        self.top, self.quoted, self.depth, self.name = top, quoted, depth, name
        self.level = 1 if top == "[" else 2
        self.cut = self.held_open = self.wanted and depth > self.level
        self.held: list[str] = []
        self.last_name: str | None = None

    @property
    def wanted(self) -> bool:
        return self.top == "[" or (self.top == "{" and self.name == "items")

    def walk(self, text: str) -> bool:
        """Take the text up to a `}` and the `}`; does that end an element?"""
        start, begun, string = 0, None, None
        for mark in _MARK.finditer(text):
            sign = mark.group()
            if sign == '"':
                if self.quoted and self.depth == 1:
                    string = text[begun : mark.start()] if begun is not None else None
                self.quoted = not self.quoted
                begun = mark.end() if self.quoted else None
            elif self.quoted or len(sign) > 1:
                continue
            elif sign == ":":
                if self.depth == 1 and self.top == "{":
                    self.name = self.last_name = string
            elif sign == "]":
                self.depth -= 1
            else:
                self.depth += 1
                if sign == "{" and self.depth == self.level + 1 and self.wanted and not self.held_open:
                    start, self.held_open = mark.start(), True
        if self.held_open:
            self.held.append(text[start:])
        self.depth -= not self.quoted
        ended = self.held_open and not self.quoted and self.depth == self.level
        self.held_open &= not ended
        return ended


def _walks(batches: Iterator[pa.RecordBatch], states: dict) -> Iterator[tuple[tuple[str, int], _Walker, str]]:
    part, walker = None, None
    for batch in batches:
        for file, block, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != part:
                part = (file, block)
                walker = _Walker(*states[part])
            yield part, walker, text


def _names(batches: Iterator[pa.RecordBatch], states: dict) -> Iterator[pa.RecordBatch]:
    """The last name on the outermost level in each part."""
    last: dict[tuple[str, int], str | None] = {}
    for part, walker, text in _walks(batches, states):
        walker.walk(text)
        walker.held.clear()
        last[part] = walker.last_name
    rows = [(*part, name) for part, name in last.items() if name is not None]
    columns = list(zip(*rows)) or [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["file", "block", "name"])


def _elements(batches: Iterator[pa.RecordBatch], states: dict) -> Iterator[pa.RecordBatch]:
    now, before, out, row = None, None, [], 0

    def leave() -> None:
        if before is not None and before.held:
            out.append((*now, INSIDE if before.cut else OPENED, row, "}".join(before.held)))

    for part, walker, text in _walks(batches, states):
        if part != now:
            leave()
            now, before, row = part, walker, 0
        if walker.walk(text):
            out.append((*part, CLOSED if walker.cut else WHOLE, row, "}".join(walker.held) + "}"))
            walker.held.clear()
            walker.cut = False
            row += 1
        if len(out) >= 1000:
            yield as_pieces(out)
            out.clear()
    leave()
    yield as_pieces(out)


def read_split_cases(spark: SparkSession, path: str, schema: str = CASE_SCHEMA) -> DataFrame:
    """The rows of `read_cases`, of large files that are read in parts by many tasks.

    Files are cut behind any `}`. One pass finds what every part does to the nesting depth, for either case of beginning inside
    a string or not; put together along a file that gives the depth at which every part begins. A second pass, over files that
    hold an object, finds the outermost name that every part begins under. Then the elements of the array (the file's own, or `items`)
    are taken out and parsed part by part; only those across a cut are shuffled. Runs these passes while it is called. Elements
    that are no objects are left out, and files that hold neither array have no rows.
    """
    texts = delimited(spark, path, "}")
    files = defaultdict(list)
    for part in told(texts.mapInArrow(_parts, _PART)):
        files[part["file"]].append(part)
    states: dict[tuple[str, int], tuple[str, bool, int, str | None]] = {}
    for file, parts in files.items():
        quoted, depth, top = False, 0, ""
        for part in sorted(parts, key=lambda p: p["block"]):
            top = part["top"] or top
            states[file, part["block"]] = (top, quoted, depth, None)
            side = "in" if quoted else "out"
            quoted, depth = part[f"quoted_{side}"], depth + part[f"moved_{side}"]
    if any(top == "{" for top, *_ in states.values()):
        names = {(r["file"], r["block"]): r["name"] for r in told(texts.mapInArrow(lambda batches: _names(batches, states), _KEYS))}
        for file, parts in files.items():
            name = None
            for block in sorted(p["block"] for p in parts):
                states[file, block] = (*states[file, block][:3], name)
                name = names.get((file, block), name)
    pieces = texts.mapInArrow(lambda batches: _elements(batches, states), PIECES)
    records = whole_records(pieces, "}")
    return records.select(F.from_json("record", schema).alias("case")).select("case.*")
