"""Price bars from ticks, latest quotes and price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import top_n


def bars(ticks: DataFrame, unit: str) -> DataFrame:
    """Open / high / low / close / volume per symbol and `unit` (minute, day, month).

    Open and close are the prices at the first and last tick, so the ticks of
    one symbol need distinct times, as the tick table's sort key says.
    """
    return ticks.groupBy("symbol", F.date_trunc(unit, "time").cast("timestamp_ntz").alias("time")).agg(
        F.min_by("price", "time").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "time").alias("close"),
        F.sum("volume").alias("volume"),
    )


def monthly_summary(daily: DataFrame) -> DataFrame:
    """Average close, highest high and lowest low per symbol and month."""
    return daily.groupBy("symbol", F.date_trunc("month", "time").alias("month")).agg(
        F.avg("close").alias("avg_close"), F.max("high").alias("month_high"), F.min("low").alias("month_low")
    )


def minute_summary(ticks: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Average price and traded volume per symbol and minute, `start` inclusive, `end` not."""
    if start is not None:
        ticks = ticks.filter(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        ticks = ticks.filter(F.col("time") < F.lit(end).cast("timestamp_ntz"))
    return ticks.groupBy("symbol", F.date_trunc("minute", "time").alias("minute")).agg(
        F.avg("price").alias("avg_price"), F.sum("volume").alias("total_vol")
    )


def performance(daily: DataFrame, as_of: str, lag_days: int = 365) -> DataFrame:
    """Latest close and the last close on or before `as_of` minus `lag_days`, per symbol."""
    cut = F.lit(as_of).cast("date") - F.expr(f"INTERVAL {int(lag_days)} DAYS")
    past = F.col("time") <= cut.cast("timestamp_ntz")
    latest = F.max_by("close", "time")
    # A null ordering value is skipped by max_by, which acts as the filter.
    before = F.max_by("close", F.when(past, F.col("time")))
    return (
        daily.groupBy("symbol")
        .agg(latest.alias("latest"), before.alias("past"))
        .withColumn("change_pct", change_pct(F.col("latest"), F.col("past")))
    )


def change_pct(now: Column, before: Column) -> Column:
    """Change in percent, to two decimals; null unless the earlier price is above 0."""
    return F.when(before > 0, F.round(F.lit(100.0) * (now - before) / before, 2))


def latest_quote(daily: DataFrame) -> DataFrame:
    """Last bar per symbol with previous close, change and change in percent.

    The three comparison columns are null unless the previous close is above 0.
    Only the last two bars of a symbol reach the shuffle.
    """
    last_two = top_n(daily, ["symbol"], [F.col("time").desc()], 2, rank="__nth")
    newest = F.col("__nth") == 1
    fields = ("time", "open", "high", "low", "close", "volume")
    quotes = last_two.groupBy("symbol").agg(
        *[F.max(F.when(newest, F.col(f))).alias(f) for f in fields],
        F.max(F.when(~newest, F.col("close"))).alias("__prev"),
    )
    prev = F.when(F.col("__prev") > 0, F.col("__prev"))
    return quotes.select(
        "symbol",
        *fields,
        prev.alias("prev_close"),
        (F.col("close") - prev).alias("change"),
        change_pct(F.col("close"), prev).alias("change_pct"),
    )


def price_history(daily: DataFrame, days: int | None = 30) -> DataFrame:
    """The last `days` bars of every symbol, numbered from the oldest."""
    days = max(1, int(days or 30))
    recent = top_n(daily, ["symbol"], [F.col("time").desc()], days)
    # At most `days` rows per symbol are left here.
    oldest_first = Window.partitionBy("symbol").orderBy("time")
    return recent.withColumn("bar_no", F.row_number().over(oldest_first).cast("long"))
