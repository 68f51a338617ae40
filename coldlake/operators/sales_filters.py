"""Sales load and filter (E1-E4): the order-line frame every sales calculation starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.functions.periods import period_label


def filter_options(dim_product: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Distinct categories (product dimension), regions and channels (customer dimension) as (kind, value)."""
    cats = dim_product.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    regs = dim_customer.select(F.lit("region").alias("kind"), F.col("region").alias("value"))
    chans = dim_customer.select(F.lit("channel").alias("kind"), F.col("acquisition_channel").alias("value"))
    return cats.unionByName(regs).unionByName(chans).distinct().orderBy("kind", "value")


def default_date_range(orders: DataFrame) -> DataFrame:
    """(latest date - 1 day, latest date); (yesterday, today) when there are no orders."""
    mx = orders.agg(F.max("order_date").alias("mx"))
    end = F.coalesce(F.col("mx"), F.current_date())
    return mx.select(F.date_sub(end, 1).alias("start"), end.alias("end"))


def load_orders(orders: DataFrame, start: str | None = None, end: str | None = None,
                categories: list[str] | None = None, regions: list[str] | None = None,
                channels: list[str] | None = None) -> DataFrame:
    """Conjunctive filter; a missing or empty list means no filter. Dates are inclusive.

    Predicates are on stored columns, so they reach the parquet scan (and prune
    date partitions when the table is partitioned by date).
    """
    cond = F.lit(True)
    partitioned = "order_year" in orders.columns     # stored tables are partitioned by year
    if start:
        cond = cond & (F.col("order_date") >= F.to_date(F.lit(start)))
        if partitioned:
            cond = cond & (F.col("order_year") >= F.year(F.to_date(F.lit(start))))
    if end:
        cond = cond & (F.col("order_date") <= F.to_date(F.lit(end)))
        if partitioned:
            cond = cond & (F.col("order_year") <= F.year(F.to_date(F.lit(end))))
    if categories:
        cond = cond & F.col("category").isin(list(categories))
    if regions:
        cond = cond & F.col("region").isin(list(regions))
    if channels:
        cond = cond & F.col("channel").isin(list(channels))
    return orders.filter(cond)


def with_period(df: DataFrame, period: str = "month", col: str = "period") -> DataFrame:
    """Add the period label column."""
    return df.withColumn(col, period_label("order_date", period))
