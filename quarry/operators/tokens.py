"""Token statistics over component logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Components in the order they run, and fallback names.
COMPONENTS = ("rewriter", "orchestrator", "rag", "db", "web", "visualize", "collector")
NO_CATEGORY = "(uncategorised)"
NO_ID = "?"

_KINDS = ("input", "output", "total")


def usage_rows(logs: DataFrame, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """Clean log rows of the known components.

    `used` is true where a model was really called, which means a positive
    total; token counts are null elsewhere. `comp_no` is the component's order.
    """
    used = F.coalesce(F.col("total_tokens"), F.lit(0)) > 0
    number = F.array_position(F.array(*[F.lit(c) for c in components]), F.col("component"))
    tokens = {k: F.when(used, F.coalesce(f"{k}_tokens", F.lit(0))) for k in _KINDS}
    return logs.filter(F.col("component").isin(*components)).select(
        "component",
        number.alias("comp_no"),
        "line",
        _or(F.col("test_id"), NO_ID).alias("test_id"),
        _or(F.col("category"), NO_CATEGORY).alias("category"),
        used.alias("used"),
        *[c.alias(k) for k, c in tokens.items()],
    )


def _or(value: Column, fallback: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", fallback).otherwise(value)


def _stats(kind: str) -> list[Column]:
    value = F.col(kind)
    zero = F.lit(0)
    return [
        F.coalesce(F.min(value), zero).cast("double").alias(f"{kind}_min"),
        F.coalesce(F.max(value), zero).cast("double").alias(f"{kind}_max"),
        F.bround(F.coalesce(F.avg(value), zero).cast("double"), 2).alias(f"{kind}_avg"),
        F.coalesce(F.sum(value), zero).cast("double").alias(f"{kind}_sum"),
    ]


def _all_stats() -> list[Column]:
    return [column for kind in _KINDS for column in _stats(kind)]


def by_component(rows: DataFrame) -> DataFrame:
    """Records, records with usage, and min / max / avg / sum of their tokens."""
    return rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("used").alias("with_usage"), *_all_stats()
    )


def per_turn(rows: DataFrame) -> DataFrame:
    """Token sums per test case; no call counts as 0, the first seen category wins."""
    seen = F.min(F.struct("comp_no", "line", "category"))["category"]
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in _KINDS]
    return rows.groupBy("test_id").agg(seen.alias("category"), *sums)


def overall(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count(F.lit(1)).alias("turns"), *_all_stats())


def by_category(turns: DataFrame) -> DataFrame:
    return turns.groupBy("category").agg(F.count(F.lit(1)).alias("turns"), *_all_stats())


def overall_and_by_category(turns: DataFrame) -> DataFrame:
    """Both roll-ups in one pass; the overall row has category null."""
    sets = [[], [F.col("category")]]
    return turns.groupingSets(sets, F.col("category")).agg(F.count(F.lit(1)).alias("turns"), *_all_stats())


def component_average(rows: DataFrame, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """Average tokens each component adds to a turn, turns without it counted as 0."""
    turns = rows.groupBy("test_id").pivot("component", list(components)).agg(F.sum("total"))
    return turns.agg(*[F.bround(F.avg(F.coalesce(c, F.lit(0))), 2).alias(c) for c in components])


def normalize_usage(prompt: Column, completion: Column, total: Column) -> Column:
    """Usage struct from differently named fields; null when all are zero."""
    pt, ct = (F.coalesce(c, F.lit(0)).cast("long") for c in (prompt, completion))
    tt = F.coalesce(F.nullif(total.cast("long"), F.lit(0)), pt + ct)
    usage = F.struct(
        pt.alias("input_tokens"), ct.alias("output_tokens"), tt.alias("total_tokens"), F.lit(1).cast("long").alias("calls")
    )
    return F.when((pt != 0) | (ct != 0) | (tt != 0), usage)


def first_nonzero(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values])
