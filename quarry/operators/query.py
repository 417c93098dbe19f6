"""Single-table query API: typed filters, select, distinct, aggregate.

A request is a plain description (dicts or the dataclasses below). It is turned
into `Column` objects, never into SQL text, so there is nothing to quote.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.versions import Table

_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")

# Spellings accepted for each filter operator.
FILTER_OPS = {
    "=": "=",
    "==": "=",
    "!=": "!=",
    "<>": "!=",
    "<": "<",
    "<=": "<=",
    ">": ">",
    ">=": ">=",
    "IN": "IN",
    "NOT IN": "NOT IN",
    "NOT_IN": "NOT IN",
    "NOTIN": "NOT IN",
    "LIKE": "LIKE",
    "NOT LIKE": "NOT LIKE",
    "NOT_LIKE": "NOT LIKE",
    "NOTLIKE": "NOT LIKE",
    "ILIKE": "ILIKE",
    "MATCH": "MATCH",
    "=~": "MATCH",
    "REGEX": "MATCH",
    "REGEXP": "MATCH",
    "NOT MATCH": "NOT MATCH",
    "!~": "NOT MATCH",
}

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}

_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class Filter:
    column: str
    op: str = "="
    value: Any = None


@dataclass(frozen=True)
class Agg:
    func: str
    column: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    column: str
    dir: str = "asc"


def _parse(kind: type, entry: Any) -> Any:
    """Accept a dataclass instance or a mapping with the same fields."""
    if isinstance(entry, kind):
        return entry
    if not isinstance(entry, Mapping):
        raise ValueError(f"expected an object, got {entry!r}")
    fields = {k: v for k, v in entry.items() if v is not None}
    if kind is Filter and "values" in fields:
        fields.setdefault("value", fields.pop("values"))
    try:
        return kind(**fields)
    except TypeError as error:
        raise ValueError(f"malformed {kind.__name__.lower()}: {entry!r}") from error


def _column(df: DataFrame, name: Any) -> Column:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"invalid column name: {name!r}")
    if name not in df.columns:
        raise ValueError(f"unknown column: {name!r}")
    return F.col(name)


def _literal(df: DataFrame, name: str, value: Any) -> Column:
    """A boolean stays one next to a boolean column and is 1 or 0 next to any other."""
    if value is None or isinstance(value, (int, float, str)):
        if isinstance(value, bool) and not isinstance(df.schema[name].dataType, T.BooleanType):
            value = int(value)
        return F.lit(value)
    raise ValueError(f"unsupported literal type: {type(value).__name__}")


def predicate(df: DataFrame, entry: Filter | Mapping) -> Column:
    """The boolean column of one filter. Null on either side is not a match."""
    f = _parse(Filter, entry)
    column = _column(df, f.column)
    op = FILTER_OPS.get(str(f.op).upper().strip())
    if op is None:
        raise ValueError(f"unsupported filter op: {f.op!r}")
    if op in ("IN", "NOT IN"):
        if not isinstance(f.value, (list, tuple)) or not f.value:
            raise ValueError(f"{op} needs a non-empty list for {f.column!r}")
        member = column.isin(*[_literal(df, f.column, v) for v in f.value])
        return member if op == "IN" else ~member
    value = _literal(df, f.column, f.value)
    if op in _COMPARE:
        return _COMPARE[op](column, value)
    if f.value is None:
        return F.lit(None).cast("boolean")
    pattern = str(f.value)
    match = {"LIKE": column.like, "ILIKE": column.ilike, "MATCH": column.rlike}[op.removeprefix("NOT ")](pattern)
    return ~match if op.startswith("NOT ") else match


def where(df: DataFrame, filters: Sequence[Filter | Mapping] | None) -> DataFrame:
    """All filters, joined by AND."""
    for entry in filters or ():
        df = df.filter(predicate(df, entry))
    return df


def limited(df: DataFrame, limit: Any) -> DataFrame:
    """The first rows; a limit that is no positive number means all rows."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        return df
    return df.limit(n) if n > 0 else df


def ordered(df: DataFrame, order_by: Sequence[Order | Mapping] | None) -> DataFrame:
    """Sort by several keys, nulls last in both directions."""
    parts = []
    for entry in order_by or ():
        o = _parse(Order, entry)
        direction = str(o.dir).lower().strip()
        if direction not in ("asc", "desc"):
            raise ValueError(f"unsupported order direction: {o.dir!r}")
        column = _column(df, o.column)
        parts.append(column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last())
    return df.orderBy(*parts) if parts else df


def _source(table: Table | DataFrame, use_final: bool) -> DataFrame:
    return table.read(use_final) if isinstance(table, Table) else table


def select_rows(
    table: Table | DataFrame,
    columns: Sequence[str] | None = None,
    filters: Sequence[Filter | Mapping] | None = None,
    order_by: Sequence[Order | Mapping] | None = None,
    limit: Any = None,
    use_final: bool = True,
) -> DataFrame:
    """Rows of one table; no columns means all of them."""
    df = ordered(where(_source(table, use_final), filters), order_by)
    if columns:
        df = df.select(*[_column(df, c) for c in columns])
    return limited(df, limit)


def distinct_values(
    table: Table | DataFrame,
    column: str,
    filters: Sequence[Filter | Mapping] | None = None,
    limit: Any = None,
    use_final: bool = True,
) -> DataFrame:
    """Distinct values of one column, ascending, as `value`."""
    df = where(_source(table, use_final), filters)
    values = df.select(_column(df, column).alias("value")).distinct()
    return limited(values.orderBy(F.col("value").asc_nulls_last()), limit)


def _aggregate_column(df: DataFrame, entry: Agg | Mapping) -> Column:
    a = _parse(Agg, entry)
    func = (a.func or "").lower().strip()
    if func not in _AGGREGATES:
        raise ValueError(f"unsupported aggregation function: {a.func!r}")
    if func == "count" and a.column in (None, "*"):
        value, name = F.count(F.lit(1)), "count(*)"
    elif not a.column:
        raise ValueError(f"aggregation {func} needs a column")
    else:
        value, name = _AGGREGATES[func](_column(df, a.column)), f"{func}({a.column})"
    if a.alias is not None and not _NAME.fullmatch(a.alias):
        raise ValueError(f"invalid alias: {a.alias!r}")
    return value.alias(a.alias or name)


def aggregate(
    table: Table | DataFrame,
    aggregations: Sequence[Agg | Mapping],
    group_by: Sequence[str] | None = None,
    filters: Sequence[Filter | Mapping] | None = None,
    order_by: Sequence[Order | Mapping] | None = None,
    limit: Any = None,
    use_final: bool = True,
) -> DataFrame:
    """sum / avg / min / max / count, grouped or over the whole table."""
    if not aggregations:
        raise ValueError("at least one aggregation is needed")
    df = where(_source(table, use_final), filters)
    measures = [_aggregate_column(df, a) for a in aggregations]
    result = df.groupBy(*[_column(df, c) for c in group_by or ()]).agg(*measures)
    return limited(ordered(result, order_by), limit)
