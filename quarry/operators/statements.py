"""Statement cubes: annual rows, latest periods, ratios, ranked children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranking import top_n


def with_annual_rows(quarters: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Add a `quarter = 0` row per symbol and year to quarterly sums.

    Works on the already summed quarters, so only small rows are expanded.
    """
    periods = quarters.withColumn("quarter", F.explode(F.array(F.col("quarter"), F.lit(0).cast("long"))))
    return periods.groupBy("symbol", "year", "quarter").agg(*[F.sum(m).alias(m) for m in measures])


def annual(statement: DataFrame) -> DataFrame:
    """Full-year rows; they are a row class of their own, not a sum of quarters."""
    return statement.filter(F.col("quarter") == 0)


def quarterly(statement: DataFrame) -> DataFrame:
    return statement.filter(F.col("quarter") > 0)


def last_years(statement: DataFrame, n: int = 5) -> DataFrame:
    """The newest `n` full-year rows per symbol."""
    return top_n(annual(statement), ["symbol"], [F.col("year").desc()], n)


def last_quarters(statement: DataFrame, n: int = 8) -> DataFrame:
    """The newest `n` quarterly rows per symbol."""
    return top_n(quarterly(statement), ["symbol"], [F.col("year").desc(), F.col("quarter").desc()], n)


def ratio(part: Column, whole: Column, scale: float = 1.0, digits: int = 2) -> Column:
    """`part / whole * scale`, rounded; null when the denominator is 0 or null."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(float(scale)), digits)


def free_cash_flow(operating: Column, capex: Column) -> Column:
    """Operating cash flow plus capital spending, which is booked as a negative."""
    return operating + capex


def to_billions(amount: Column) -> Column:
    return F.round(amount / F.lit(1e9), 1)


def to_percent(share: Column) -> Column:
    return F.round(share * F.lit(100.0), 2)


def top_children(children: DataFrame, parent: str, by: str, tie: Sequence[str], n: int) -> DataFrame:
    """The `n` largest child rows per parent (holders, officers, subsidiaries, news)."""
    order = [F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]]
    return top_n(children, [parent], order, n, rank="child_no")


def sector_ranking(ratios: DataFrame, members: DataFrame, by: str, n: int) -> DataFrame:
    """Best `n` symbols among the members of a sector."""
    inside = ratios.join(members.select("symbol"), "symbol", "left_semi")
    return inside.orderBy(F.col(by).desc_nulls_last(), F.col("symbol")).limit(n)


def overview(statement: DataFrame, ratios: DataFrame, holders: DataFrame) -> DataFrame:
    """One row per symbol: latest statement and ratio figures with the top holders.

    Inputs hold at most one row (statement, ratios) or a few rows (holders) per
    symbol, so the collected holder list is bounded.
    """
    by_symbol = holders.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("child_no", "holder", "amount"))).alias("holders")
    )
    return statement.join(ratios, "symbol", "full_outer").join(by_symbol, "symbol", "full_outer")


def pie_shares(slices: DataFrame, label: str, value: str) -> DataFrame:
    """Positive slices with their share of the total in percent, one decimal.

    The total is a scalar subquery, so no window over the whole input is needed.
    """
    positive = slices.select(
        F.coalesce(F.col(label).cast("string"), F.lit("(null)")).alias(label), F.col(value).try_cast("double").alias(value)
    ).filter(F.col(value) > 0)
    total = positive.agg(F.sum(value).alias("total")).scalar()
    return positive.withColumn("pct", F.round(F.lit(100.0) * F.col(value) / total, 1))


def chart_series(points: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """Label as text, values as double or null; points without any value are dropped."""
    rest = [c for c in points.columns if c not in (label, *values)]
    numbers = [F.col(v).try_cast("double").alias(v) for v in values]
    typed = points.select(F.col(label).cast("string").alias(label), *rest, *numbers)
    return typed.filter(F.coalesce(*values).isNotNull())
