"""Category, product, channel and region mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_GEO, DEFAULT_RULES, REGION_GEO, Rules
from coldlake.functions.numeric import half_even, money, pct
from coldlake.operators.common import prefix_sum


def _sum_by(df: DataFrame, keys: list[str], measure: str = "revenue") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(measure))


def revenue_by_category(df: DataFrame) -> DataFrame:
    """F6."""
    s = _sum_by(df, ["category"])
    return s.orderBy(F.col("revenue").desc(), "category").select("category", money("revenue").alias("revenue"))


def revenue_by_product(df: DataFrame, limit: int = 15) -> DataFrame:
    """top N (product, category) by revenue."""
    s = _sum_by(df, ["product_id", "category"])
    return (s.orderBy(F.col("revenue").desc(), "product_id", "category").limit(limit)
            .select("product_id", "category", money("revenue").alias("revenue")))


def profit_by_product(df: DataFrame, limit: int = 15) -> DataFrame:
    """F8: top N by gross profit."""
    s = _sum_by(df, ["product_id", "category"], "gross_profit")
    return (s.orderBy(F.col("gross_profit").desc(), "product_id", "category").limit(limit)
            .select("product_id", "category", money("gross_profit").alias("gross_profit")))


def bottom_products(df: DataFrame, limit: int = 10) -> DataFrame:
    """lowest revenue."""
    s = _sum_by(df, ["product_id", "category"])
    return (s.orderBy(F.col("revenue").asc(), "product_id", "category").limit(limit)
            .select("product_id", "category", money("revenue").alias("revenue")))


def _geo(region: Column, idx: int) -> Column:
    kv = []
    for k, v in REGION_GEO.items():
        kv += [F.lit(k), F.lit(float(v[idx]))]
    return F.coalesce(F.try_element_at(F.create_map(*kv), region), F.lit(DEFAULT_GEO[idx]))


def sales_by_region(df: DataFrame) -> DataFrame:
    """revenue per region with the static map position (literal map lookup, default for others)."""
    s = _sum_by(df, ["region"])
    return s.select("region", money("revenue").alias("revenue"), F.col("region").alias("state"),
                    _geo(F.col("region"), 0).alias("lat"), _geo(F.col("region"), 1).alias("lon"))


def revenue_by_state(df: DataFrame) -> DataFrame:
    """F10."""
    s = _sum_by(df, ["state"])
    return s.orderBy(F.col("revenue").desc(), "state").select("state", money("revenue").alias("revenue"))


def sales_by_channel(df: DataFrame) -> DataFrame:
    """F18."""
    s = _sum_by(df, ["channel"])
    return s.orderBy(F.col("revenue").desc(), "channel").select("channel", money("revenue").alias("revenue"))


def channel_profitability(df: DataFrame) -> DataFrame:
    """F20."""
    return df.groupBy("channel").agg(money(F.sum("revenue")).alias("revenue"),
                                     money(F.sum("gross_profit")).alias("gross_profit"),
                                     money(F.sum("net_profit")).alias("net_profit"))


def _share(df: DataFrame, key: str) -> DataFrame:
    """Revenue per key and its share of the total; the total is a window over the (small) grouped frame."""
    s = _sum_by(df, [key])
    total = F.sum("revenue").over(W.partitionBy())
    share = F.when(total == 0, F.lit(0.0)).otherwise(half_even(pct("revenue", total), 1))
    return (s.select(key, money("revenue").alias("revenue"), share.alias("share_pct"))
            .orderBy(F.col("revenue").desc(), key))


def channel_share(df: DataFrame) -> DataFrame:
    """F45."""
    return _share(df, "channel")


def category_share(df: DataFrame) -> DataFrame:
    """F46."""
    return _share(df, "category")


def pareto(df: DataFrame) -> DataFrame:
    """products by revenue desc with running revenue and cumulative % (1 dp; 0 when the total is 0).

    The running sum is a distributed prefix sum (range partitions + per-partition
    offsets), so no single task ever holds all products.
    """
    s = _sum_by(df, ["product_id"])
    order = [F.col("revenue").desc(), F.col("product_id").asc()]
    run = prefix_sum(s, order, "revenue", "cumulative_revenue", total="total").orderBy(*order)
    total = F.col("total")
    cum_pct = F.when(total == 0, F.lit(0.0)).otherwise(half_even(pct("cumulative_revenue", total), 1))
    return run.select("product_id", money("revenue").alias("revenue"),
                      money("cumulative_revenue").alias("cumulative_revenue"), cum_pct.alias("cumulative_pct"))


def discount_impact(df: DataFrame) -> DataFrame:
    """bucket = discount x 100 rounded half-even to an integer."""
    b = F.bround(F.col("discount_pct") * F.lit(100.0), 0).cast("int")
    return (df.groupBy(b.alias("discount_bucket")).agg(money(F.sum("revenue")).alias("revenue"),
                                                       F.count_distinct("order_id").alias("orders"))
            .orderBy("discount_bucket"))


def basket_size(df: DataFrame) -> DataFrame:
    """orders per total quantity (negative for returns)."""
    per = df.groupBy("order_id").agg(F.sum("quantity").alias("basket_size"))
    return (per.groupBy("basket_size").agg(F.count(F.lit(1)).alias("orders")).orderBy("basket_size"))


def margins_by(df: DataFrame, key: str, with_sums: bool = False) -> DataFrame:
    """Ratio of sums x 100, 1 dp (NULL when revenue sums to 0)."""
    s = df.groupBy(key).agg(F.sum("gross_profit").alias("g"), F.sum("net_profit").alias("n"),
                            F.sum("revenue").alias("r"))
    cols = [key]
    if with_sums:
        cols += [money("g").alias("gross_profit"), money("n").alias("net_profit"), money("r").alias("revenue")]
    cols += [half_even(pct("g", "r"), 1).alias("gross_margin"), half_even(pct("n", "r"), 1).alias("net_margin")]
    return s.select(*cols)


def category_margin(df: DataFrame) -> DataFrame:
    """F52."""
    return margins_by(df, "category")


def channel_margin(df: DataFrame) -> DataFrame:
    """F53."""
    return margins_by(df, "channel")


def regional_performance(df: DataFrame) -> DataFrame:
    """lines meet at (region, order, customer) grain first; only that expands for the two distinct counts."""
    per = df.groupBy("region", "order_id", "customer_id").agg(F.sum("revenue").alias("revenue"))
    return per.groupBy("region").agg(money(F.sum("revenue")).alias("revenue"),
                                    F.count_distinct("order_id").alias("orders"),
                                    F.count_distinct("customer_id").alias("customers"))


def top_deals(df: DataFrame, limit: int = 10) -> DataFrame:
    """orders by revenue with their mean line discount, top N."""
    per = df.groupBy("order_id").agg(F.sum("revenue").alias("revenue"), F.avg("discount_pct").alias("discount_pct"))
    return (per.orderBy(F.col("revenue").desc(), "order_id").limit(limit)
            .select("order_id", money("revenue").alias("revenue"), F.bround("discount_pct", 6).alias("discount_pct")))


# ------------------------------------------------------------------ G: values computed in the pages

def net_profit_by_category(df: DataFrame) -> DataFrame:
    """G1: ascending."""
    s = _sum_by(df, ["category"], "net_profit")
    return s.orderBy("net_profit", "category").select("category", money("net_profit").alias("net_profit"))


def customers_by_state(df: DataFrame) -> DataFrame:
    """Distinct customers per state, ascending."""
    return (df.groupBy("state").agg(F.count_distinct("customer_id").alias("customers"))
            .orderBy("customers", "state"))


def regional_margins(df: DataFrame) -> DataFrame:
    """G3."""
    return margins_by(df, "region", with_sums=True)


def latest_orders(df: DataFrame, limit: int = 50) -> DataFrame:
    """Newest lines (ties by order_line_id) with the feed's eight columns."""
    top = df.orderBy(F.col("order_date").desc(), F.col("order_line_id").desc()).limit(limit)
    return top.select("order_id", "order_date", "customer_id", "category", "channel", "quantity",
                      money("revenue").alias("revenue"), "discount_pct")


def score_band(score: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Executive score band."""
    return (F.when(score >= rules.exec_good, F.lit("POSITIVE")).when(score >= rules.exec_fair, F.lit("NEUTRAL"))
            .otherwise(F.lit("NEGATIVE")))
