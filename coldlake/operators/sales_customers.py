"""Customer analytics.

Per-customer windows never run over order lines: lines are first reduced to
(customer, month) rows with a partially-aggregated ``groupBy`` (a customer holding
a third of all lines still contributes at most one row per month), and the window
runs over that bounded frame.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldlake.config import SEGMENT_EDGES, SEGMENT_LABELS
from coldlake.functions.numeric import half_even, money, pct
from coldlake.functions.periods import period_label


def customer_distribution(df: DataFrame) -> DataFrame:
    """distinct customers per region."""
    return df.groupBy("region").agg(F.count_distinct("customer_id").alias("customers"))


def customer_months(df: DataFrame) -> DataFrame:
    """(customer_id, period, lines) at month grain, with the customer's first month."""
    cm = df.groupBy("customer_id", period_label("order_date", "month").alias("period")).agg(
        F.count(F.lit(1)).alias("lines"))
    return cm.withColumn("first_period", F.min("period").over(W.partitionBy("customer_id")))


def active_by_period(df: DataFrame) -> DataFrame:
    """the set of active customers per month, as distinct (period, customer_id) rows."""
    return df.select(period_label("order_date", "month").alias("period"), "customer_id").distinct()


def new_vs_returning(df: DataFrame) -> DataFrame:
    """ORDER LINES per month, split by whether the month is the customer's first month."""
    cm = customer_months(df)
    is_new = F.col("period") == F.col("first_period")
    return (cm.groupBy("period").agg(
        F.sum(F.when(is_new, F.col("lines")).otherwise(0)).cast("long").alias("new"),
        F.sum(F.when(~is_new, F.col("lines")).otherwise(0)).cast("long").alias("returning"))
        .orderBy("period"))


def activity_series(df: DataFrame) -> DataFrame:
    """Customer sets by day and month as counts that add up, from one pass over the lines.

    Lines become (customer_id, order_date) rows, at most one per customer and calendar day
    however many lines a customer holds; each such row then knows whether it is the
    customer's first of the month and of all time, so no distinct aggregate is needed. One
    output row per (order_date, month, came_from): ``month`` numbers calendar months,
    ``came_from`` is the customer's previous active month on its first day of a month (else
    null). ``customers_of_day``, ``customers_of_month`` and ``customers`` count distinct
    customers; ``active`` (of the month) and ``groups`` (of all time) also count the null
    customer as one, ``repeaters`` are those of ``groups`` with more than one order. The result has
    a row per day and earlier month at most: everything after it is small.
    """
    by_day, whole = W.partitionBy("customer_id").orderBy("order_date"), W.partitionBy("customer_id")
    days = df.groupBy("customer_id", "order_date").agg(
        F.sum("revenue").alias("rev"), F.sum("gross_profit").alias("gross"), F.sum("net_profit").alias("net"),
        F.min("order_id").alias("lo"), F.max("order_id").alias("hi"))
    days = days.withColumn("month", F.year("order_date") * 12 + F.month("order_date"))
    marked = days.select("*", F.lag("month").over(by_day).alias("before"), (F.row_number().over(by_day) == 1).alias("first"),
                         (F.min("lo").over(whole) != F.max("hi").over(whole)).alias("repeats"))
    known, opens = F.col("customer_id").isNotNull(), F.col("first") | ~F.col("before").eqNullSafe(F.col("month"))
    return (marked.groupBy("order_date", "month", F.when(opens, F.col("before")).alias("came_from"))
            .agg(*[F.sum(m).alias(m) for m in ("rev", "gross", "net")],
                 F.count_if(known).alias("customers_of_day"), F.count_if(opens & known).alias("customers_of_month"),
                 F.count_if(F.col("first") & known).alias("customers"), F.count_if(opens).alias("active"),
                 F.count_if("first").alias("groups"), F.count_if(F.col("first") & F.col("repeats")).alias("repeaters")))


def retention_rate(df: DataFrame) -> DataFrame:
    """share of the previous OBSERVED month's customers active again this month.

    A customer is retained when the month it was last active in is the last observed one:
    both are known in the month-grain activity series, from one scan and without a join.
    """
    monthly = activity_series(df.withColumn("order_date", F.trunc("order_date", "month"))).where(F.col("month").isNotNull())
    seen = monthly.withColumn("observed", F.max("month").over(W.orderBy("month").rangeBetween(W.unboundedPreceding, -1)))
    kept = F.when(F.col("came_from") == F.col("observed"), F.col("active")).otherwise(0)
    by_month = seen.groupBy(period_label("order_date", "month").alias("period")).agg(
        F.sum("active").alias("active"), F.sum(kept).alias("retained"))
    prev_active = F.lag("active").over(W.orderBy("period"))
    out = by_month.select(
        "period",
        F.when(prev_active.isNull() | (prev_active == 0), F.lit(0.0))
        .otherwise(half_even(pct("retained", prev_active), 1)).alias("retention"),
        F.when(prev_active.isNull() | (prev_active == 0), F.lit(0.0))
        .otherwise(half_even(pct(prev_active - F.col("retained"), prev_active), 1)).alias("churn"))
    return out.orderBy("period")


def clv(df: DataFrame) -> DataFrame:
    """revenue per distinct customer, 2 dp."""
    return df.agg(F.coalesce(half_even(F.try_divide(F.sum("revenue").cast("double"),
                                                    F.count_distinct("customer_id")), 2), F.lit(0.0)).alias("clv"))


def orders_per_customer(df: DataFrame) -> DataFrame:
    """(customer_id, orders = distinct orders, revenue)."""
    return df.groupBy("customer_id").agg(F.count_distinct("order_id").alias("orders"),
                                         F.sum("revenue").alias("revenue"))


def repeat_purchase_rate(df: DataFrame) -> DataFrame:
    """F16: % of customers with more than one distinct order, 1 dp."""
    return repeaters(df).select(F.coalesce(half_even(pct("repeaters", "groups"), 1), F.lit(0.0)).alias("repeat_rate"))


def repeaters(df: DataFrame) -> DataFrame:
    """One row (groups, repeaters): customers, the null one included, and those with more than
    one order, told by their least and greatest order id instead of a distinct count."""
    per = df.groupBy("customer_id").agg((F.min("order_id") != F.max("order_id")).alias("repeats"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.count_if("repeats").alias("repeaters"))


def top_customers(df: DataFrame, limit: int = 10) -> DataFrame:
    """revenue per customer with the region of its earliest line (first non-null), top N."""
    first_key = F.when(F.col("region").isNotNull(), F.struct("order_date", "order_line_id"))
    per = df.groupBy("customer_id").agg(F.sum("revenue").alias("revenue"),
                                        F.min_by("region", first_key).alias("region"))
    return (per.orderBy(F.col("revenue").desc(), "customer_id").limit(limit)
            .select("customer_id", "region", money("revenue").alias("revenue")))


def customers_vs_revenue(df: DataFrame) -> DataFrame:
    """F33."""
    return orders_per_customer(df).select("customer_id", "orders", money("revenue").alias("revenue"))


def cohort_retention(df: DataFrame) -> DataFrame:
    """distinct customers by (first month, order month), long form (cohort, month, customers)."""
    cm = customer_months(df)
    return (cm.groupBy(F.col("first_period").alias("cohort"), F.col("period").alias("month"))
            .agg(F.count(F.lit(1)).alias("customers")).orderBy("cohort", "month"))


def cohort_pivot(cohorts: DataFrame, months: list[str]) -> DataFrame:
    """Wide cohort matrix for an explicit month list (no eager distinct job), missing = 0."""
    return cohorts.groupBy("cohort").pivot("month", months).agg(F.sum("customers")).na.fill(0).orderBy("cohort")


def customer_segments(df: DataFrame, edges: list[float] | None = None, labels: list[str] | None = None) -> DataFrame:
    """customers and revenue per right-closed revenue bin; every segment present, empty ones 0.

    One conditional aggregate per segment over the per-customer frame, then one row per
    segment from the fixed label list - no join.
    """
    edges = SEGMENT_EDGES if edges is None else edges
    labels = SEGMENT_LABELS if labels is None else labels
    per = orders_per_customer(df)
    rev = F.col("revenue")
    aggs, rows = [], []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = rev > F.lit(Decimal(str(lo)))
        if hi != float("inf"):
            cond = cond & (rev <= F.lit(Decimal(str(hi))))
        aggs += [F.count_if(cond).alias(f"c{i}"),
                 F.coalesce(F.sum(F.when(cond, rev)), F.lit(Decimal(0))).alias(f"r{i}")]
        rows.append(F.struct(F.lit(lab).alias("segment"), F.col(f"c{i}").alias("customers"),
                             money(F.col(f"r{i}")).alias("revenue")))
    wide = per.agg(*aggs)
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.segment", "s.customers", "s.revenue")


def order_frequency(df: DataFrame) -> DataFrame:
    """number of customers per distinct-order count."""
    return (orders_per_customer(df).groupBy(F.col("orders").alias("frequency"))
            .agg(F.count(F.lit(1)).alias("customers")).orderBy("frequency"))
