"""Time-series sales calculations.

Every series is aggregated to its period grain first; ``lag`` windows then run
over that small period series (at most a few thousand rows even at 100 TB), never
over order lines.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_RULES, Rules
from coldlake.functions.numeric import money
from coldlake.functions.periods import hash_hour, period_label, week_label, weekday_name, weekday_position
from coldlake.operators.common import stat


def _series(df: DataFrame, period: str, measure: str) -> DataFrame:
    return df.groupBy(period_label("order_date", period).alias("period")).agg(F.sum(measure).alias(measure))


def revenue_by_period(df: DataFrame, period: str = "month") -> DataFrame:
    """F2."""
    s = _series(df, period, "revenue")
    return s.select("period", money("revenue").alias("revenue")).orderBy("period")


def profit_by_month(df: DataFrame) -> DataFrame:
    """F3."""
    s = df.groupBy(period_label("order_date", "month").alias("period")).agg(
        F.sum("gross_profit").alias("g"), F.sum("net_profit").alias("n"))
    return s.select("period", money("g").alias("gross_profit"), money("n").alias("net_profit")).orderBy("period")


def _with_target(series: DataFrame, measure: str, growth: float) -> DataFrame:
    """F4 helper: target = previous observed period's value x (1 + growth); the first period uses itself."""
    prev = F.lag(measure).over(W.orderBy("period"))
    factor = F.lit(Decimal(str(1 + growth)))
    target = F.bround(F.coalesce(prev, F.col(measure)) * factor, 2).cast("double")
    return series.select("period", money(measure).alias(measure), target.alias("target")).orderBy("period")


def sales_vs_target(df: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """F4."""
    return _with_target(_series(df, "month", "revenue"), "revenue", rules.target_growth)


def profit_vs_target(df: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """same on net profit (a negative previous value gives a lower target)."""
    return _with_target(_series(df, "month", "net_profit"), "net_profit", rules.target_growth)


def _waterfall(df: DataFrame, measure: str) -> DataFrame:
    s = _series(df, "month", measure)
    prev = F.lag(measure).over(W.orderBy("period"))
    change = F.coalesce(F.col(measure) - prev, F.col(measure))
    return s.select("period", money(measure).alias(measure), money(change).alias("change")).orderBy("period")


def revenue_waterfall(df: DataFrame) -> DataFrame:
    """change vs previous observed month; the first month's change is its value."""
    return _waterfall(df, "revenue")


def profit_waterfall(df: DataFrame) -> DataFrame:
    """F37."""
    return _waterfall(df, "net_profit")


def _growth(df: DataFrame, period: str, clamp: float) -> DataFrame:
    """pct_change * 100 vs the previous observed period; first = 0; x/0 -> +-clamp; 0/0 -> NULL (NaN)."""
    s = _series(df, period, "revenue").select("period", F.col("revenue").cast("double").alias("revenue"))
    prev = F.lag("revenue").over(W.orderBy("period"))
    cur = F.col("revenue")
    raw = (F.when(prev.isNull(), F.lit(0.0))
           .when((prev == 0) & (cur == 0), F.lit(None).cast("double"))
           .when(prev == 0, F.when(cur > 0, F.lit(clamp)).otherwise(F.lit(-clamp)))
           .otherwise((cur / prev - F.lit(1.0)) * F.lit(100.0)))
    # least/greatest skip NULLs, so the 0/0 case (NaN in the reference) must bypass the clamp
    g = F.when(raw.isNotNull(), F.greatest(F.least(raw, F.lit(clamp)), F.lit(-clamp)))
    return s.select("period", F.bround("revenue", 2).alias("revenue"), stat(g).alias("growth_pct")).orderBy("period")


def mom_growth(df: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """F47."""
    return _growth(df, "month", rules.period_growth_clamp)


def yoy_growth(df: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """calendar-year totals."""
    return _growth(df, "year", rules.period_growth_clamp)


def _rev_orders(df: DataFrame, key: Column, name: str) -> DataFrame:
    return (df.groupBy(key.alias(name)).agg(money(F.sum("revenue")).alias("revenue"),
                                            F.count_distinct("order_id").alias("orders")).orderBy(name))


def sales_by_hour(df: DataFrame) -> DataFrame:
    """hour = first 8 hex digits of SHA-256(order_id) mod 24."""
    return _rev_orders(df, hash_hour("order_id"), "hour")


def sales_by_day(df: DataFrame) -> DataFrame:
    """order LINES per day of month (column named orders)."""
    return df.groupBy(F.dayofmonth("order_date").alias("day")).agg(F.count(F.lit(1)).alias("orders")).orderBy("day")


def sales_by_dow(df: DataFrame) -> DataFrame:
    """F32: revenue and distinct orders per weekday name, Monday first."""
    out = df.groupBy(weekday_name("order_date").alias("weekday")).agg(
        money(F.sum("revenue")).alias("revenue"), F.count_distinct("order_id").alias("orders"))
    return out.orderBy(weekday_position("weekday"))


def realtime_metrics(df: DataFrame) -> DataFrame:
    """orders, revenue and customers within one minute of the latest order time (inclusive).

    Order dates are day-level, so this is the latest day: the stored date column is compared
    with the latest date, an uncorrelated scalar subquery, and year partitions with its year.
    """
    latest = df.agg(F.max("order_date")).scalar()
    recent = df.filter(F.col("order_date") >= latest)
    if "order_year" in df.columns:
        recent = recent.filter(F.col("order_year") >= F.year(latest))
    return recent.agg(F.count_distinct("order_id").alias("orders_last_min"),
                      F.coalesce(F.sum("revenue"), F.lit(Decimal(0))).cast("double").alias("revenue_last_min"),
                      F.count_distinct("customer_id").alias("active_customers"))


def hourly_trends(df: DataFrame) -> DataFrame:
    """by hour of the order timestamp (always 0 for date-only data)."""
    return _rev_orders(df, F.hour(F.col("order_date").cast("timestamp")), "hour")


def daily_trends(df: DataFrame) -> DataFrame:
    """F43."""
    return _rev_orders(df, F.col("order_date"), "date")


def weekly_trends(df: DataFrame) -> DataFrame:
    """Monday-Sunday weeks labelled 'start/end'."""
    return _rev_orders(df, week_label("order_date"), "week")
