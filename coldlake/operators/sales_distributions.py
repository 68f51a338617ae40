"""Relationships and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.functions.numeric import floor_div, money
from coldlake.functions.periods import period_label
from coldlake.operators.ops_reports import correlation_long

MONEY_COLS = {"revenue", "cost", "gross_profit", "net_profit"}


def _as_double(c: str) -> Column:
    return F.col(c).cast("double").alias(c)


def projection(df: DataFrame, x: str, y: str) -> DataFrame:
    """two-column scatter inputs, one row per order line (money as double)."""
    return df.select(_as_double(x) if x in MONEY_COLS else F.col(x), _as_double(y) if y in MONEY_COLS else F.col(y))


def equal_width_distribution(values: DataFrame, col: str = "x", bins: int = 20) -> DataFrame:
    """equal-width buckets between the data's min and max.

    bucket = round((x - lo) // step * step + lo, 2) with Python floor-division semantics,
    so the maximum lands in its own (bins + 1)-th bucket; lo == hi gives one bucket.
    lo and hi come from one small aggregate used as scalar subqueries (no join).
    """
    v = values.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    st = v.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    lo, hi = st["lo"], st["hi"]   # one subquery, referenced twice (reused, not re-run)
    step = (hi - lo) / F.lit(float(bins))
    edge = F.when(lo == hi, lo).otherwise(floor_div(F.col("x") - lo, step) * step + lo)
    # snap to 10 decimals before the half-even rounding, so binary noise never decides a tie
    bucket = F.bround(edge.cast("decimal(38,10)"), 2).cast("double")
    return v.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count")).orderBy("bucket")


def revenue_distribution(df: DataFrame, bins: int = 20) -> DataFrame:
    """F24 (revenue per line)."""
    return equal_width_distribution(df, "revenue", bins)


def profit_distribution(df: DataFrame, bins: int = 20) -> DataFrame:
    """F24 (net profit per line)."""
    return equal_width_distribution(df, "net_profit", bins)


def customer_spend_distribution(df: DataFrame, bins: int = 20) -> DataFrame:
    """revenue summed per customer first."""
    per = df.groupBy("customer_id").agg(F.sum("revenue").alias("spend"))
    return equal_width_distribution(per, "spend", bins)


def price_distribution(df: DataFrame, bins: int = 20) -> DataFrame:
    """unit price per LINE."""
    return equal_width_distribution(df, "unit_price", bins)


def margin_distribution(df: DataFrame, bins: int = 20) -> DataFrame:
    """net / revenue x 100 per line; zero-revenue lines are dropped."""
    m = df.select((F.col("net_profit").cast("double") / F.nullif(F.col("revenue").cast("double"), F.lit(0.0))
                   * F.lit(100.0)).alias("margin"))
    return equal_width_distribution(m, "margin", bins)


def kpi_heatmap(df: DataFrame) -> DataFrame:
    """revenue by (category, month) in long form; absent pairs mean 0."""
    return (df.groupBy("category", period_label("order_date", "month").alias("period"))
            .agg(money(F.sum("revenue")).alias("revenue")).orderBy("category", "period"))


def heatmap_pivot(long: DataFrame, months: list[str]) -> DataFrame:
    """Wide heatmap for an explicit month list (no eager distinct job), missing = 0."""
    return long.groupBy("category").pivot("period", months).agg(F.sum("revenue")).na.fill(0.0).orderBy("category")


SALES_CORR_COLUMNS = ["quantity", "unit_price", "discount_pct", "revenue", "cost", "gross_profit", "net_profit"]


def sales_correlation_matrix(df: DataFrame) -> DataFrame:
    """Pearson over the seven numeric line columns, long form, 2 dp."""
    return correlation_long(df, SALES_CORR_COLUMNS)
