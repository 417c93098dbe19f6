"""Queries for bars, quotes, statements and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import market, statements
from quarry.plans.registry import query
from quarry.plans.tables import BARS, CASHFLOW, MONTH_TICKS, STATEMENT, TICKS, day_text, sql_round, time_text
from quarry.sources.warehouse import with_month


@query(
    "bars_daily",
    f"WITH {BARS} SELECT symbol, strftime(time, '%Y-%m-%d') AS day, open, high, low, close, volume FROM bars",
)
def _bars_daily(data):
    return data.bars().select("symbol", day_text("time").alias("day"), "open", "high", "low", "close", "volume")


@query(
    "bars_monthly",
    f"""
    WITH {BARS}
    SELECT symbol, strftime(date_trunc('month', time), '%Y-%m-%d') AS month, {sql_round("avg(close)", 6)} AS avg_close,
           max(high) AS month_high, min(low) AS month_low FROM bars GROUP BY 1, 2
    """,
)
def _bars_monthly(data):
    monthly = market.monthly_summary(data.bars())
    return monthly.withColumns({"month": day_text("month"), "avg_close": F.round("avg_close", 6)})


@query(
    "bars_minute",
    f"""
    WITH {TICKS}
    SELECT symbol, strftime(date_trunc('minute', time), '%Y-%m-%d %H:%M:%S') AS minute,
           {sql_round("avg(price)", 6)} AS avg_price, CAST(sum(volume) AS BIGINT) AS total_vol
    FROM ticks WHERE time >= TIMESTAMP '2024-01-02 09:00:00' AND time < TIMESTAMP '2024-01-25 15:00:00' GROUP BY 1, 2
    """,
)
def _bars_minute(data):
    minutes = market.minute_summary(data.ticks(), "2024-01-02 09:00:00", "2024-01-25 15:00:00")
    return minutes.withColumns({"minute": time_text("minute"), "avg_price": F.round("avg_price", 6)})


@query(
    "perf_vs_past",
    f"""
    WITH {BARS}, p AS (
      SELECT symbol, arg_max(close, time) AS latest,
             arg_max(close, time) FILTER (WHERE time <= TIMESTAMP '2024-01-30' - INTERVAL 14 DAYS) AS past
      FROM bars GROUP BY 1)
    SELECT symbol, latest, past, CASE WHEN past > 0 THEN {sql_round("100.0 * (latest - past) / past", 2)} END AS change_pct FROM p
    """,
)
def _perf_vs_past(data):
    return market.performance(data.bars(), "2024-01-30", 14)


@query(
    "latest_quote",
    f"""
    WITH {BARS}, r AS (
      SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS prev,
             row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rn FROM bars)
    SELECT symbol, strftime(time, '%Y-%m-%d') AS day, open, high, low, close, volume,
           CASE WHEN prev > 0 THEN prev END AS prev_close,
           CASE WHEN prev > 0 THEN {sql_round("close - prev", 6)} END AS change,
           CASE WHEN prev > 0 THEN {sql_round("100.0 * (close - prev) / prev", 2)} END AS change_pct
    FROM r WHERE rn = 1
    """,
)
def _latest_quote(data):
    quote = market.latest_quote(data.bars())
    return quote.withColumn("change", F.round("change", 6)).withColumn("day", day_text("time")).drop("time")


@query(
    "price_history",
    f"""
    WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rn FROM bars)
    SELECT symbol, strftime(time, '%Y-%m-%d') AS day, close, row_number() OVER (PARTITION BY symbol ORDER BY time) AS bar_no
    FROM r WHERE rn <= 10
    """,
)
def _price_history(data):
    return market.price_history(data.bars(), 10).select("symbol", day_text("time").alias("day"), "close", "bar_no")


@query(
    "month_part_counts",
    f"WITH {MONTH_TICKS} SELECT CAST(year(time) * 100 + month(time) AS BIGINT) AS yyyymm, count(*) AS n FROM month_ticks GROUP BY 1",
)
def _month_part_counts(data):
    return with_month(data.month_ticks(), "time").groupBy(F.col("yyyymm").cast("long").alias("yyyymm")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stmt_last_years",
    f"""
    WITH {STATEMENT}, r AS (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS rn FROM stmt WHERE quarter = 0)
    SELECT symbol, year, round(revenue, 2) AS revenue FROM r WHERE rn <= 5
    """,
)
def _stmt_last_years(data):
    return statements.last_years(data.statement(), 5).select("symbol", "year", F.round("revenue", 2).alias("revenue"))


@query(
    "stmt_last_quarters",
    f"""
    WITH {STATEMENT}, r AS (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC, quarter DESC) AS rn FROM stmt WHERE quarter > 0)
    SELECT symbol, year, quarter, round(revenue, 2) AS revenue FROM r WHERE rn <= 8
    """,
)
def _stmt_last_quarters(data):
    latest = statements.last_quarters(data.statement(), 8)
    return latest.select("symbol", "year", "quarter", F.round("revenue", 2).alias("revenue"))


@query(
    "free_cash_flow",
    f"""
    WITH {CASHFLOW}
    SELECT symbol, year, operating AS cfo, capex, round(operating + capex, 4) AS fcf FROM cashflow
    """,
)
def _free_cash_flow(data):
    fcf = statements.free_cash_flow(F.col("operating"), F.col("capex"))
    return data.cashflow().select("symbol", "year", F.col("operating").alias("cfo"), "capex", F.round(fcf, 4).alias("fcf"))


@query(
    "balance_ratios",
    f"""
    WITH {CASHFLOW}
    SELECT symbol, year, {sql_round("tax / nullif(operating, 0) * 100", 2)} AS tax_margin_pct,
           {sql_round("operating / nullif(quantity, 0)", 2)} AS price_per_unit FROM cashflow
    """,
)
def _balance_ratios(data):
    return data.cashflow().select(
        "symbol",
        "year",
        statements.ratio(F.col("tax"), F.col("operating"), 100).alias("tax_margin_pct"),
        statements.ratio(F.col("operating"), F.col("quantity")).alias("price_per_unit"),
    )


@query(
    "pie_shares",
    f"""
    WITH v AS (
      SELECT r_name AS label, sum(CASE WHEN r_name = 'ASIA' THEN -o_totalprice ELSE o_totalprice END) AS value
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
    p AS (SELECT * FROM v WHERE value > 0)
    SELECT label, round(value, 2) AS value, {sql_round("100 * value / (SELECT sum(value) FROM p)", 1)} AS pct FROM p
    """,
)
def _pie_shares(data):
    by_customer = data.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    placed = (
        by_customer.join(data.table("customer"), "c_custkey")
        .join(data.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(data.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    signed = F.when(F.col("r_name") == "ASIA", -F.col("total")).otherwise(F.col("total"))
    slices = placed.groupBy(F.col("r_name").alias("label")).agg(F.sum(signed).alias("value"))
    return statements.pie_shares(slices, "label", "value").withColumn("value", F.round("value", 2))
