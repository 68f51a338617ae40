"""Order-table maintenance and dimension rules (A6-A9, A15-A20) as DataFrame transformations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.config import OPEX_RATIO, ORDER_RETENTION_HOURS
from coldlake.functions.sensor import row_key

MONEY = "decimal(15,2)"


def cancel_lines(orders: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Order lines without the cancelled ``order_line_id`` s (anti-join; the key list is
    shuffled like any other side unless AQE measures it small)."""
    return orders.join(cancelled.select("order_line_id"), "order_line_id", "left_anti")


def return_lines(orders: DataFrame, returned: DataFrame | Column) -> DataFrame:
    """Negated copies of the returned lines (listed by id, or where a condition holds): new line
    id (hash of the original, so a retry produces the same rows), order id + '-RET', quantity
    negated, money as -|x|."""
    src = orders.where(returned) if isinstance(returned, Column) else orders.join(returned.select("order_line_id"), "order_line_id", "left_semi")
    neg = {c: (-F.abs(F.col(c))).cast(MONEY) for c in ("revenue", "cost", "gross_profit", "net_profit")}
    return src.withColumns({
        "order_line_id": row_key("order_line_id", F.lit("RET")),
        "order_id": F.concat(F.col("order_id"), F.lit("-RET")),
        "quantity": -F.col("quantity"),
        **neg,
    }).select(*orders.columns)


def apply_returns(orders: DataFrame, returned: DataFrame | Column) -> DataFrame:
    """A4 + A7: the order table with return rows added (replace-by-key, so re-applying is a no-op).
    With a condition the caller has taken out earlier copies, and no join is needed."""
    ret = return_lines(orders, returned)
    if isinstance(returned, Column):
        return orders.unionByName(ret)
    return orders.join(ret.select("order_line_id"), "order_line_id", "left_anti").unionByName(ret)


def retention_cutoff(as_of: Column, hours: int = ORDER_RETENTION_HOURS) -> Column:
    """First date kept: date(as_of - hours)."""
    return F.to_date(as_of - F.make_dt_interval(hours=F.lit(hours)))


def purge_before(orders: DataFrame, cutoff: Column) -> DataFrame:
    """Keep order_date >= cutoff (strict < is deleted). On a date-partitioned table this
    filter prunes whole partitions."""
    keep = F.col("order_date") >= cutoff
    if "order_year" in orders.columns:           # year-partitioned storage: drop whole partitions
        keep = keep & (F.col("order_year") >= F.year(cutoff))
    return orders.filter(keep)


def random_sample(df: DataFrame, n: int, seed: int = 42, key: str = "order_line_id") -> DataFrame:
    """N random rows: the least by a SHA-256 of seed and key, so the sample is the same under
    any partitioning and on every run (a top-k per partition, then a merge; no full sort)."""
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key)), 256)
    return df.orderBy(draw, key).limit(n)


def derive_line_measures(lines: DataFrame, products: DataFrame, opex_ratio: float = OPEX_RATIO) -> DataFrame:
    """Revenue, cost, gross and net profit from quantity, price, discount and the product's unit cost.

    Inputs keep eight decimals; only the results are rounded to cents.
    """
    q = F.col("quantity").cast("decimal(10,0)")
    price = F.col("unit_price").cast("decimal(18,8)")
    disc = F.col("discount_pct").cast("decimal(9,8)")
    rev = (q * price * (F.lit(Decimal(1)) - disc)).cast(MONEY)
    cost = (q * F.col("unit_cost").cast("decimal(18,8)")).cast(MONEY)
    out = lines.join(products.select("product_id", "unit_cost"), "product_id", "left")
    out = out.withColumns({"revenue": rev, "cost": cost})
    return out.withColumns({
        "gross_profit": (F.col("revenue") - F.col("cost")).cast(MONEY),
        "net_profit": (F.col("revenue") - F.col("cost") - F.col("revenue") * F.lit(Decimal(str(opex_ratio))))
        .cast(MONEY),
    }).drop("unit_cost")


def denormalize_lines(lines: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Copy region/state/city/channel from the customer and category from the product."""
    c = customers.select("customer_id", "region", "state", "city", F.col("acquisition_channel").alias("channel"))
    p = products.select("product_id", "category")
    return lines.join(c, "customer_id", "left").join(p, "product_id", "left")


def first_order_dates(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Each customer's earliest order date; customers without orders get the data's first date."""
    firsts = orders.groupBy("customer_id").agg(F.min("order_date").alias("first_order_date"))
    start = orders.agg(F.min("order_date")).scalar()
    return (customers.drop("first_order_date").join(firsts, "customer_id", "left")
            .withColumn("first_order_date", F.coalesce(F.col("first_order_date"), start)))


def missing_members(expected: DataFrame, dim: DataFrame, col: str) -> DataFrame:
    """Expected values absent from the dimension (set difference)."""
    return expected.select(col).distinct().join(dim.select(col).distinct(), col, "left_anti")


def seed_master_data(store, dim_vehicle: DataFrame, dim_shipment: DataFrame) -> None:
    """Insert the vehicle and shipment dimensions; rows already stored win (insert-if-absent)."""
    store.insert_if_absent("dim_vehicle", dim_vehicle)
    store.insert_if_absent("dim_shipment", dim_shipment)
