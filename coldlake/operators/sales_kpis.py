"""Headline sales KPIs (F1, F15-F16 via customers, F29, F38, F40).

Scalar results are one-row DataFrames. Growth compares the last two OBSERVED months
(or, with fewer than two months, the last two observed days); both series are
aggregated to period grain first and the last two rows are picked from that small
series - no window over order lines.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_RULES, FUNNEL_STAGES, Rules
from coldlake.functions.numeric import clamp, half_even, pct
from coldlake.operators.common import attach_scalars
from coldlake.operators.sales_customers import activity_series, repeaters


def _kpi_row(df: DataFrame, rules: Rules) -> DataFrame:
    """One row of totals, growth, mean retention and repeat rate from the activity series.

    Grouping sets and windows see that series only (a row per day and earlier month), in one
    partition from there on.
    """
    earlier = W.orderBy("month").rangeBetween(W.unboundedPreceding, -1)
    series = activity_series(df).repartition(1).withColumn("observed", F.max("month").over(earlier))
    gs = (series.groupingSets([[], ["month"], ["order_date"]], "month", "order_date")
          .agg(*[F.sum(m).alias(m) for m in ("rev", "gross", "net", "customers", "active", "groups", "repeaters")],
               F.sum("customers_of_month").alias("of_month"), F.sum("customers_of_day").alias("of_day"),
               F.sum(F.when(F.col("came_from") == F.col("observed"), F.col("active")).otherwise(0)).alias("kept"),
               F.grouping_id().alias("gid")))
    TOTAL, MONTH, DAY = 3, 1, 2   # grouping_id over (month, order_date)
    key = F.coalesce(F.col("month"), F.unix_date("order_date"))
    of_gid, dated = W.partitionBy("gid"), W.partitionBy("gid", F.col("month").isNull()).orderBy("month")
    ranked = gs.select("*", F.row_number().over(of_gid.orderBy(key.desc())).alias("rn"), F.count(F.lit(1)).over(of_gid).alias("n"),
                       F.lag("active").over(dated).alias("was_active"),
                       F.when(F.col("gid") == MONTH, F.col("of_month")).when(F.col("gid") == DAY, F.col("of_day"))
                       .otherwise(F.col("customers")).alias("cust"))
    retention = F.when(F.coalesce(F.col("was_active"), F.lit(0)) == 0, F.lit(0.0)).otherwise(half_even(pct("kept", "was_active"), 1))

    def pick(gid: int, rn: int, m: str) -> Column:
        return F.max(F.when((F.col("gid") == gid) & (F.col("rn") == rn), F.col(m)))

    def g(gid: int, m: str) -> Column:
        cur, pre = pick(gid, 1, m).cast("double"), pick(gid, 2, m).cast("double")
        return F.when(pre == 0, F.lit(0.0)).otherwise((cur - pre) / pre * F.lit(100.0))

    out = ranked.agg(
        pick(TOTAL, 1, "rev").alias("rev"), pick(TOTAL, 1, "gross").alias("gross"),
        pick(TOTAL, 1, "net").alias("net"), pick(TOTAL, 1, "cust").alias("customers"),
        F.avg(F.when((F.col("gid") == MONTH) & F.col("month").isNotNull(), retention)).alias("avg_retention"),
        half_even(pct(pick(TOTAL, 1, "repeaters"), pick(TOTAL, 1, "groups")), 1).alias("repeat_rate"),
        F.max(F.when(F.col("gid") == MONTH, F.col("n"))).alias("m_n"),
        F.max(F.when(F.col("gid") == DAY, F.col("n"))).alias("d_n"),
        *[g(MONTH, m).alias(f"m_{m}_g") for m in ("rev", "net", "cust")],
        *[g(DAY, m).alias(f"d_{m}_g") for m in ("rev", "net", "cust")])
    c = rules.kpi_growth_clamp

    def growth(m: str) -> Column:
        v = (F.when(F.col("m_n") >= 2, F.col(f"m_{m}_g"))
             .when(F.col("d_n") >= 2, F.col(f"d_{m}_g")).otherwise(F.lit(0.0)))
        return F.coalesce(half_even(F.when(v.isNotNull(), clamp(v, c)), 1), F.lit(0.0))

    rev = F.col("rev").cast("double")
    return out.select(
        F.coalesce(F.bround("rev", 2).cast("double"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.col("customers"), F.lit(0)).alias("customers"),
        F.coalesce(F.bround("gross", 2).cast("double"), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(half_even(pct("gross", "rev"), 1), F.lit(0.0)).alias("gross_margin"),
        F.coalesce(F.bround("net", 2).cast("double"), F.lit(0.0)).alias("net_profit"),
        F.coalesce(half_even(pct("net", "rev"), 1), F.lit(0.0)).alias("net_margin"),
        growth("rev").alias("revenue_growth"),
        growth("net").alias("profit_growth"),
        growth("cust").alias("customer_growth"),
        F.coalesce(half_even(F.try_divide(rev, F.col("customers")), 2), F.lit(0.0)).alias("arpc"),
        rev.alias("exact_revenue"), "avg_retention", F.coalesce("repeat_rate", F.lit(0.0)).alias("repeat_rate"),
    )


def kpis(df: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """revenue, orders, customers, AOV, gross/net profit and margins, ARPC and growth
    (last two observed months, else last two observed days, else 0; clamped).

    Distinct orders are counted by a second scan of that one column: its ids then travel alone.
    """
    out = attach_scalars(_kpi_row(df, rules), df.agg(F.count_distinct("order_id").alias("transactions")))
    aov = F.coalesce(half_even(F.try_divide(F.col("exact_revenue"), F.col("transactions")), 2), F.lit(0.0)).alias("aov")
    return out.select("revenue", "transactions", "customers", aov, "gross_profit", "gross_margin", "net_profit", "net_margin",
                      "revenue_growth", "profit_growth", "customer_growth", "arpc")


def executive_score(df: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """weighted 0-100 score from rounded KPIs, mean monthly retention (first month's 0
    included) and the repeat-purchase rate, all from one scan of the lines."""
    out = _kpi_row(df, rules)

    def capped(x: Column, full: float) -> Column:
        return F.least(x / F.lit(full), F.lit(1.0))

    score = (F.lit(0.25) * capped(F.col("gross_margin"), 60.0)
             + F.lit(0.20) * capped(F.greatest(F.col("revenue_growth"), F.lit(0.0)), 20.0)
             + F.lit(0.20) * capped(F.col("net_margin"), 40.0)
             + F.lit(0.20) * capped(F.coalesce(F.col("avg_retention"), F.lit(0.0)), 80.0)
             + F.lit(0.15) * capped(F.col("repeat_rate"), 100.0)) * F.lit(100.0)
    has_rows = F.col("avg_retention").isNotNull()   # one retention row per observed month
    return out.select(F.when(has_rows, half_even(score, 1)).otherwise(F.lit(0.0)).alias("executive_score"))


def sales_funnel(df: DataFrame) -> DataFrame:
    """lines, distinct orders, distinct customers, repeat customers - in fixed stage order.

    Lines are pre-aggregated to (customer, order) grain; every count is then taken on that
    smaller frame (a single pass over the lines, no Expand of distinct aggregates).
    """
    co = df.groupBy("customer_id", "order_id").agg(F.count(F.lit(1)).alias("lines"))
    per_c = co.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))
    a = co.agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("v0"),
               F.count_distinct("order_id").alias("v1"))
    b = per_c.agg(F.count(F.lit(1)).alias("v2"), F.count_if(F.col("orders") > 1).alias("v3"))
    one = attach_scalars(a, b)
    rows = [F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(f"v{i}").cast("long").alias("value"))
            for i, s in enumerate(FUNNEL_STAGES)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.stage", "r.value").orderBy(
        F.array_position(F.array(*[F.lit(s) for s in FUNNEL_STAGES]), F.col("stage")))


def advanced_kpis(df: DataFrame) -> DataFrame:
    """distinct orders, mean line quantity and discount (x100), total cost, repeat %, CLV."""
    tot = df.agg(F.count_distinct("order_id").alias("total_orders"),
                 F.coalesce(half_even(F.avg("quantity"), 1), F.lit(0.0)).alias("avg_qty"),
                 F.coalesce(half_even(F.avg("discount_pct") * F.lit(100.0), 1), F.lit(0.0)).alias("avg_disc"),
                 F.coalesce(F.bround(F.sum("cost"), 2), F.lit(Decimal(0))).cast("double").alias("total_cost"),
                 F.sum("revenue").alias("_rev"))
    out = attach_scalars(tot, repeaters(df))
    return out.select("total_orders", "avg_qty", "avg_disc", "total_cost",
                      F.coalesce(half_even(pct("repeaters", "groups"), 1), F.lit(0.0)).alias("repeat_rate"),
                      F.coalesce(half_even(F.try_divide(F.col("_rev").cast("double"), F.col("groups")), 2), F.lit(0.0))
                      .alias("clv"))
