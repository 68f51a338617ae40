"""Deterministic views of the domain tables over the driver's parquet tables.

``events`` becomes a stream of raw sensor events (with replayed duplicates), and
the TPC-H-like star schema becomes denormalized order lines. Every view is a lazy
plan over the whole input tables; nothing is sampled or collected.
"""

from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldlake.config import (DELIVERY_STATUSES, DESTINATIONS, FOOD_CATEGORIES, REFRIGERATION_TYPES, TEMP_RANGES,
                             VEHICLE_TYPES, WAREHOUSES, RunClock)
from coldlake.functions.sensor import safe_bounds

# Fixed fixture parameters (see FIXTURES.md).
REPLAY_EVERY = 500          # events whose id is a multiple of this arrive a second time
EVENTS_PER_RUN = 500        # consecutive event ids that arrive in one pipeline run
N_VEHICLES = 30


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], idx: Column) -> Column:
    """Element ``idx`` (0-based) of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + F.lit(1)).cast("int"))


def raw_sensor_arrivals(spark: SparkSession, sf_dir: str, clock: RunClock = RunClock(),
                        events_per_run: int = EVENTS_PER_RUN) -> DataFrame:
    """Raw sensor events as they arrive: the RAW_SENSOR_EVENTS columns plus
    ``batch_id`` (the pipeline run that receives the row) and ``arrival_seq``
    (arrival order inside the run, 0 = first copy, 1 = replayed copy).
    """
    ev = read_table(spark, sf_dir, "events")
    return arrivals_from_events(ev, clock, events_per_run)


def arrivals_from_events(events: DataFrame, clock: RunClock = RunClock(),
                         events_per_run: int = EVENTS_PER_RUN) -> DataFrame:
    """The fixture mapping on any ``events`` frame, batch or streaming (narrow operations only)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    arrivals = ev.withColumn("arrival_seq", F.lit(0)).unionByName(
        ev.filter(F.col("event_id") % F.lit(REPLAY_EVERY) == F.lit(0)).withColumn("arrival_seq", F.lit(1)))
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    # measures derived in decimal so that rounding ties resolve identically in every engine
    v = F.col("value").cast("decimal(18,2)")
    batch_id = F.floor(eid / F.lit(events_per_run)).cast("long")
    ingested = run_start(batch_id, clock)
    return arrivals.select(
        F.concat(F.lit("E"), eid.cast("string")).alias("event_id"),
        F.when(eid % 977 == 3, F.lit(None).cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
        .alias("event_timestamp"),
        F.when(eid % 991 == 1, F.lit(None).cast("string")).when(eid % 991 == 2, F.lit(""))
        .otherwise(F.concat(F.lit("SHIP-"), F.lpad((k % 60 + 1).cast("string"), 4, "0"))).alias("shipment_id"),
        F.when(eid % 983 == 5, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("V"), F.lpad((F.col("user_id") % 30 + 1).cast("string"), 3, "0")))
        .alias("vehicle_id"),
        _pick(WAREHOUSES, F.col("user_id") % 8).alias("warehouse"),
        _pick(DESTINATIONS, F.col("user_id") % 10).alias("destination"),
        _pick(FOOD_CATEGORIES, F.col("user_id") % 12).alias("food_category"),
        F.round(v % 52 - F.lit(Decimal("11.5")), 2).cast("double").alias("temperature_c"),
        F.round((v * 7) % 102, 1).cast("double").alias("humidity_pct"),
        (F.lit(18.9) + k / F.lit(300)).alias("latitude"),
        F.when(eid % 971 == 7, F.lit(200.0)).otherwise(F.lit(72.8) + k / F.lit(300)).alias("longitude"),
        F.when(F.col("event_type") == F.lit("error"), F.lit(1)).otherwise(F.lit(0)).alias("door_open"),
        F.when(eid % 967 == 8, F.lit(101.0)).otherwise(k.cast("double")).alias("battery_pct"),
        F.round((v * 3) % 162, 1).cast("double").alias("speed_kmh"),
        _pick(DELIVERY_STATUSES, eid % 6).alias("delivery_status"),
        ingested.alias("ingested_at"),
        batch_id.alias("batch_id"),
        F.col("arrival_seq"),
    )


def run_start(batch_id: Column, clock: RunClock = RunClock()) -> Column:
    """Processing time of run ``batch_id`` on the deterministic backfill clock."""
    start = datetime.strptime(clock.start, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp()
    return F.timestamp_seconds(F.lit(int(start)) + batch_id * F.lit(clock.cycle_seconds))


def dim_shipment(spark: SparkSession, sf_dir: str, clock: RunClock = RunClock(),
                 arrivals: DataFrame | None = None) -> DataFrame:
    """Shipment dimension seeded from the shipment ids observed in the raw events: category,
    warehouse and destination by position n ('SHIP-nnnn', else a checksum of the id), bounds
    from the category's safe range (A15, A16). Grows with the data; a distinct over one column.
    ``arrivals`` may be a frame already holding the arrivals (e.g. a persisted batch)."""
    src = arrivals if arrivals is not None else raw_sensor_arrivals(spark, sf_dir, clock)
    ids = src.select("shipment_id").filter(F.col("shipment_id") != F.lit("")).distinct()
    number = F.regexp_extract("shipment_id", r"^SHIP-([0-9]{1,9})$", 1)
    n = F.when(number != "", number.try_cast("int")).otherwise((F.crc32(F.encode("shipment_id", "UTF-8")) % 480 + 1).cast("int"))
    df = ids.select(
        "shipment_id",
        _pick(FOOD_CATEGORIES, (n - 1) % 12).alias("food_category"),
        _pick(WAREHOUSES, (n - 1) % 8).alias("warehouse"),
        _pick(DESTINATIONS, (n - 1) % 10).alias("destination"),
    )
    low, high = safe_bounds("food_category", TEMP_RANGES)
    return df.select("*", low.alias("required_min_temp"), high.alias("required_max_temp"),
                     F.to_timestamp(F.lit(clock.start)).alias("created_at"))


def dim_vehicle(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    return spark.range(1, N_VEHICLES + 1).select(
        F.concat(F.lit("V"), F.lpad(n.cast("string"), 3, "0")).alias("vehicle_id"),
        _pick(VEHICLE_TYPES, (n - 1) % 3).alias("vehicle_type"),
        _pick(REFRIGERATION_TYPES, (n - 1) % 3).alias("refrigeration_type"),
        (F.lit(800.0) + (n - 1) * F.lit(110.0)).alias("capacity_kg"),
    )


def _dec(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x.cast("decimal(15,2)")


def fact_order(spark: SparkSession, sf_dir: str, opex_ratio: float = 0.08) -> DataFrame:
    """Denormalized order lines (grain = order line) with money in decimal(15,2).

    nation and region are fixed 25- and 5-row tables, so they are broadcast; the
    other joins are left to AQE, which broadcasts only sides measured small at runtime.
    Customers meet the orders, not their lines, so the lines are shuffled twice at most and
    carry no text but the part's type.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")

    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    cust = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
    placed = o.join(cust, o.o_custkey == cust.c_custkey)
    lines = li.join(p, li.l_partkey == p.p_partkey).join(placed, li.l_orderkey == placed.o_orderkey)

    revenue = _dec(_dec("l_extendedprice") * (F.lit(Decimal(1)) - _dec("l_discount")))
    cost = _dec(_dec("l_quantity") * _dec("p_retailprice"))
    return (lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_line_id"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("state"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("channel"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_discount").alias("discount_pct"),
        revenue.alias("revenue"),
        cost.alias("cost"),
    ).withColumns({
        "gross_profit": _dec(F.col("revenue") - F.col("cost")),
        "net_profit": _dec(F.col("revenue") - F.col("cost") - F.col("revenue") * F.lit(Decimal(str(opex_ratio)))),
        "hour": F.lit(12),
    }))


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey).select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("state"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("acquisition_channel"),
    )


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_cost"),
        F.col("p_retailprice").alias("list_price"),
    )


def returned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_line_ids of lines with l_returnflag = 'R' (the deterministic return feed)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_returnflag") == F.lit("R")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_line_id"))


def cancelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_line_ids of lines whose order has status 'P' (the deterministic cancellation feed)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == F.lit("P")).select("o_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_line_id"))
