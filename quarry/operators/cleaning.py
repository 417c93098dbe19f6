"""Column clean-up for incoming tables: names, types, defaults, fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date layouts accepted in CSV exports, in the order they are tried.
CSV_DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy")
EPOCH_DATE = "1970-01-01"
EPOCH_TIME = "1970-01-01 00:00:00"

_NAME_MARKS = str.maketrans({" ": "_", "-": "_", ".": "_"})
_HEADER_MARKS = str.maketrans({" ": "_", "-": "_", ".": "_", "(": None, ")": None, "%": "pct"})

_NUMBERS = {"double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType()}


def clean_name(name: str) -> str:
    return name.strip().translate(_NAME_MARKS)


def header_name(name: str) -> str:
    """Canonical spelling of a CSV header."""
    return name.strip().lower().translate(_HEADER_MARKS)


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(clean_name, df.columns))


def first_date(column: Column, formats: Sequence[str] = CSV_DATE_FORMATS) -> Column:
    """The first layout that parses, else null."""
    return F.coalesce(*[F.try_to_date(column, f) for f in formats])


def number(column: Column, kind: str) -> Column:
    """Drop thousands separators and cast; null when it is not a number."""
    return F.regexp_replace(column.cast("string"), ",", "").try_cast(_NUMBERS[kind])


def date_or_epoch(column: Column) -> Column:
    return F.coalesce(F.try_to_date(column, "yyyy-MM-dd"), F.lit(EPOCH_DATE).cast("date"))


def timestamp_or_epoch(column: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(column, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(column, F.lit("yyyy-MM-dd")),
        F.lit(EPOCH_TIME).cast("timestamp"),
    )


def cast_date_columns(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Parse the named string columns as `date` or `datetime`; others are left alone."""
    parsers = {"date": date_or_epoch, "datetime": timestamp_or_epoch}
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: parsers[kind](F.col(c)) for c, kind in kinds.items() if c in texts})


def fill_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    present = {c: v for c, v in defaults.items() if c in df.columns}
    return df.fillna(present) if present else df


@dataclass(frozen=True)
class Field:
    """A target column: type, whether null is allowed, and what replaces null."""

    kind: str = "string"
    nullable: bool = True
    fallback: Any = None


def convert(column: Column, field: Field) -> Column:
    if field.kind == "date":
        value = first_date(column.cast("string"))
    elif field.kind in _NUMBERS:
        value = number(column, field.kind)
    else:
        value = column.cast("string")
    if field.nullable or field.fallback is None:
        return value
    return F.coalesce(value, F.lit(field.fallback))


def missing(name: str, field: Field) -> Column:
    """The value of a non-null target column that the input does not have."""
    if field.fallback is not None:
        return F.lit(field.fallback).cast(_NUMBERS.get(field.kind, T.StringType()))
    return F.expr("uuid()") if name == "id" else F.lit("")


def shape_to_schema(df: DataFrame, schema: Mapping[str, Field], aliases: Mapping[str, str]) -> DataFrame:
    """Rename by header and alias, drop unknown columns, cast, add what is missing.

    Of several headers with the same meaning the first is kept. Columns are
    addressed by position, because raw headers may repeat.
    """
    first: dict[str, int] = {}
    for position, header in enumerate(df.columns):
        name = header_name(header)
        first.setdefault(aliases.get(name, name), position)
    raw = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    known = [convert(F.col(f"c{at}"), schema[name]).alias(name) for name, at in first.items() if name in schema]
    added = [
        missing(name, field).alias(name)
        for name, field in schema.items()
        if name not in first and not field.nullable
    ]
    return raw.select(*known, *added)
