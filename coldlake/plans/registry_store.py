"""Registered queries of the write protocol, row rules and streams.

Stores and streams of these queries live in a new folder below the checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake import oracle_sql as O
from coldlake.functions import sensor as fx
from coldlake.operators import maintenance as M
from coldlake.operators.sensor_pipeline import incidents_of, mark_duplicates, raw_payload
from coldlake.plans.catalog import Catalog
from coldlake.schemas import FACT_ORDER
from coldlake.session import ensure_checkpoint_dir
from coldlake.sources import fixtures
from coldlake.sources.order_store import OrderStore
from coldlake.sources.tables import SchemaMismatch, TableStore, export_csv, load_checked
from coldlake.streaming import order_feed, sensor_stream

QUERIES: dict[str, tuple] = {}


def q(name: str, sql: str):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def folder(c: Catalog, name: str) -> str:
    return f"{ensure_checkpoint_dir(c.spark)}/{name}-{uuid.uuid4().hex[:8]}"


def kept(c: Catalog, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in a folder of its own, for a query that reads them several times."""
    path = folder(c, name)
    rows.write.option("compression", "zstd").parquet(path)
    return c.spark.read.schema(rows.schema).parquet(path)


def new_store(c: Catalog, name: str) -> TableStore:
    return TableStore(c.spark, folder(c, name))


# ------------------------------------------------------------------ A: tables

@q("A01_table_scan", O.sensor("""
SELECT event_id, shipment_id, temperature_c FROM fact WHERE shipment_id = 'SHIP-0007' AND temperature_c > 5"""))
def _a01(c: Catalog):
    store = new_store(c, "a01")
    store.commit("fact_sensor_reading", c.fact)
    return store.read("fact_sensor_reading").where("shipment_id = 'SHIP-0007' AND temperature_c > 5").select(
        "event_id", "shipment_id", "temperature_c")


@q("A02_lookup_source", O.sensor("""
SELECT DISTINCT a.food_category, coalesce(r.lo, -30.0) AS lo, coalesce(r.hi, 30.0) AS hi
FROM arrivals a LEFT JOIN temp_ranges r ON r.cat = a.food_category"""))
def _a02(c: Catalog):
    low, high = fx.safe_bounds()
    return c.sensor_batch.arrivals.select("food_category").distinct().select("food_category", low.alias("lo"), high.alias("hi"))


@q("A03_insert_if_absent", O.sensor("""
SELECT event_id, event_timestamp, temperature_c FROM raw"""))
def _a03(c: Catalog):
    """Later copies come first, then every arrival again: the stored rows are the first arrivals."""
    store = new_store(c, "a03")
    rows = c.sensor_batch.arrivals
    store.insert_if_absent("raw_sensor_events", rows, "arrival_seq")
    store.insert_if_absent("raw_sensor_events", rows.withColumn("temperature_c", F.lit(-1.0)), "arrival_seq")
    return store.read("raw_sensor_events").select("event_id", "event_timestamp", "temperature_c")


@q("A04_replace_by_key", O.sales("""
SELECT order_line_id, CASE WHEN order_date >= DATE '1996-01-01' THEN -quantity ELSE quantity END AS quantity FROM fo"""))
def _a04(c: Catalog):
    store = OrderStore(c.spark, folder(c, "a04"), buckets=1)
    orders = kept(c, c.orders, "a04-orders")
    store.load(orders)
    store.upsert(orders.where("order_date >= DATE '1996-01-01'").withColumn("quantity", -F.col("quantity")))
    return store.read().select("order_line_id", "quantity")


@q("A08_purge_partitions", O.sales("""
SELECT strftime(order_date, '%Y-%m') AS order_month, count(*) AS lines, min(order_date) AS first_date FROM fo
WHERE order_date >= DATE '1996-03-15' GROUP BY 1"""))
def _a08_store(c: Catalog):
    """Older months are deleted as folders, the cutoff's month is rewritten."""
    store = OrderStore(c.spark, folder(c, "a08"), buckets=1)
    store.load(c.orders)
    store.purge_before("1996-03-15")
    return store.read().groupBy(F.date_format("order_date", "yyyy-MM").alias("order_month")).agg(F.count("*").alias("lines"), F.min("order_date").alias("first_date"))


@q("A06_rewritten_partitions", O.sales("""
, p AS (SELECT strftime(order_date, '%Y-%m') AS order_month, CAST('0x' || substr(sha256(order_line_id), 1, 4) AS INTEGER) % 2 AS bucket,
         order_date BETWEEN DATE '1996-02-10' AND DATE '1996-03-20' AND quantity > 45 AS gone FROM fo)
SELECT order_month, bucket, bool_or(gone) AS rewritten FROM p GROUP BY 1, 2 HAVING NOT bool_and(gone)"""))
def _a06_store(c: Catalog):
    """Lines of a few weeks are cancelled: which partitions have other files afterwards."""
    store = OrderStore(c.spark, folder(c, "a06"), buckets=2)
    store.load(c.orders)
    path = folder(c, "a06-files")
    store.files().write.parquet(path)
    store.cancel(kept(c, c.orders.where("order_date BETWEEN DATE '1996-02-10' AND DATE '1996-03-20' AND quantity > 45").select("order_line_id"), "a06-keys"))
    old = c.spark.read.parquet(path).withColumn("old", F.lit(True))
    now = store.files().join(old, ["order_month", "bucket", "file"], "left")
    return now.groupBy("order_month", "bucket").agg(F.max(F.col("old").isNull()).alias("rewritten"))


@q("A05_append", O.sensor("""
SELECT run_id, rows_generated FROM runs UNION ALL SELECT run_id, rows_generated FROM runs"""))
def _a05(c: Catalog):
    store = new_store(c, "a05")
    store.append("pipeline_runs", c.runs)
    store.append("pipeline_runs", c.runs)
    return store.read("pipeline_runs").select("run_id", "rows_generated")


@q("A09_sample_check", O.sales("""
SELECT least(50, count(*)) AS n_rows, least(50, count(*)) AS n_distinct, least(50, count(*)) AS n_members FROM fo"""))
def _a09(c: Catalog):
    """The sample's size, its different lines, and how many of them are lines of the table."""
    sample = M.random_sample(c.orders.select("order_line_id"), 50)
    member = c.orders.select(F.col("order_line_id").alias("known"))
    return sample.join(member, F.col("order_line_id") == F.col("known"), "left").agg(
        F.count("*").alias("n_rows"), F.count_distinct("order_line_id").alias("n_distinct"), F.count("known").alias("n_members"))


_DIM_CUSTOMER = "(SELECT count(*) FROM customer)"


@q("A11_schema_check", O.sales(f"""
SELECT 'fact_order' AS table_name, true AS accepted, count(*) AS rows_read FROM fo
UNION ALL SELECT 'dim_product', true, (SELECT count(*) FROM part)
UNION ALL SELECT 'dim_customer', true, {_DIM_CUSTOMER}
UNION ALL SELECT 'dim_vehicle (missing)', true, 0
UNION ALL SELECT 'fact_order (quantity as text)', false, 0
UNION ALL SELECT 'dim_product (without its key)', false, 0"""))
def _a11(c: Catalog):
    """The schema-checked load over stored tables: rows read per table, a missing one empty, a wrong one refused."""
    base = folder(c, "a11")
    c.orders.select(*[f.name for f in FACT_ORDER.fields]).write.parquet(f"{base}/0")
    # the wrong table is made of the stored lines, which are joined once
    orders, products = c.spark.read.schema(FACT_ORDER).parquet(f"{base}/0"), c.dim_product
    stored = {"fact_order": ("fact_order", None), "dim_product": ("dim_product", products), "dim_customer": ("dim_customer", c.dim_customer),
              "dim_vehicle (missing)": ("dim_vehicle", None), "fact_order (quantity as text)": ("fact_order", orders.withColumn("quantity", F.col("quantity").cast("string"))),
              "dim_product (without its key)": ("dim_product", products.drop("product_id"))}
    out = None
    for k, (shown, (name, rows)) in enumerate(stored.items()):
        if rows is not None:
            rows.write.parquet(f"{base}/{k}")
        try:
            loaded = load_checked(c.spark, name, f"{base}/{k}")
            one = loaded.agg(F.lit(shown).alias("table_name"), F.lit(True).alias("accepted"), F.count("*").alias("rows_read"))
        except SchemaMismatch:
            one = c.spark.range(1).select(F.lit(shown).alias("table_name"), F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("rows_read"))
        out = one if out is None else out.unionByName(one)
    return out


@q("A12_column_default", O.sales("SELECT order_line_id, CAST(12 AS INTEGER) AS hour FROM fo"))
def _a12(c: Catalog):
    store = new_store(c, "a12")
    store.append("fact_order", c.orders.drop("hour"))
    return store.read("fact_order").select("order_line_id", "hour")


@q("A13_csv_export", O.sales("SELECT order_line_id, quantity, CAST(revenue AS DOUBLE) AS revenue FROM fo"))
def _a13(c: Catalog):
    path = folder(c, "a13")
    export_csv(c.orders.select("order_line_id", "quantity", "revenue"), path)
    return c.spark.read.schema("order_line_id string, quantity int, revenue double").option("header", True).csv(path)


@q("A14_payload_json", O.sensor("""
SELECT event_id, shipment_id, temperature_c, door_open, delivery_status, shipment_id IS NULL AS null_is_kept
FROM labelled WHERE rejection_reason IS NOT NULL"""))
def _a14(c: Catalog):
    """The payload of each rejected event, parsed back."""
    p = F.from_json("raw_payload", "event_id string, shipment_id string, temperature_c double, door_open int, delivery_status string").alias("p")
    return c.rejects.select(p, "raw_payload").select(
        "p.*", F.coalesce(F.col("raw_payload").contains('"shipment_id":null'), F.lit(False)).alias("null_is_kept"))


@q("A15_seed_dimensions", O.sensor("""
SELECT shipment_id, food_category, warehouse FROM dim_shipment"""))
def _a15(c: Catalog):
    store = new_store(c, "a15")
    M.seed_master_data(store, c.dim_vehicle, c.dim_shipment)
    M.seed_master_data(store, c.dim_vehicle, c.dim_shipment.withColumn("warehouse", F.lit("Elsewhere")))
    return store.read("dim_shipment").select("shipment_id", "food_category", "warehouse")


@q("A17_line_measures", O.sales("""
, src AS (SELECT order_line_id, quantity, unit_price, discount_pct + 0.00125 AS disc, p_retailprice
          FROM fo JOIN part ON product_id = 'P' || p_partkey),
m AS (SELECT order_line_id,
        CAST(CAST(quantity AS DECIMAL(10,0)) * CAST(unit_price AS DECIMAL(18,8)) * (1 - CAST(disc AS DECIMAL(9,8))) AS DECIMAL(15,2)) AS revenue,
        CAST(CAST(quantity AS DECIMAL(10,0)) * CAST(p_retailprice AS DECIMAL(18,8)) AS DECIMAL(15,2)) AS cost FROM src)
SELECT order_line_id, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost, CAST(revenue - cost AS DOUBLE) AS gross_profit,
       CAST(CAST(revenue - cost - revenue * 0.08 AS DECIMAL(15,2)) AS DOUBLE) AS net_profit FROM m"""))
def _a17(c: Catalog):
    """Derived from quantity, price and a discount with more than two decimals."""
    lines = c.orders.select("order_line_id", "product_id", "quantity", "unit_price", (F.col("discount_pct") + 0.00125).alias("discount_pct"))
    out = M.derive_line_measures(lines, c.dim_product)
    return out.select("order_line_id", *[F.col(m).cast("double").alias(m) for m in ("revenue", "cost", "gross_profit", "net_profit")])


# ------------------------------------------------------------------ B: row rules

def _awkward(arrivals: DataFrame) -> DataFrame:
    """The arrivals, a NULL event_id on every seventh warehouse's rows, and all rows of one shipment twice."""
    rows = arrivals.withColumn("event_id", F.when(F.col("warehouse") != "Port Hub", F.col("event_id")))
    return rows.unionByName(rows.where("shipment_id = 'SHIP-0011'"))


AWKWARD_SQL = """
, odd AS (SELECT CASE WHEN warehouse <> 'Port Hub' THEN event_id END AS event_id, batch_id, shipment_id FROM arrivals),
every AS (SELECT * FROM odd UNION ALL SELECT * FROM odd WHERE shipment_id = 'SHIP-0011')
"""


@q("B01_duplicate_detection", O.sensor(AWKWARD_SQL + """
SELECT batch_id, event_id, count(*) AS arrivals, count(*) - 1 AS duplicates FROM every GROUP BY batch_id, event_id"""))
def _b01(c: Catalog):
    """Per run and event_id: arrivals and how many of them are duplicates (NULL ids and equal copies included)."""
    return mark_duplicates(_awkward(c.sensor_batch.arrivals)).groupBy("batch_id", "event_id").agg(
        F.count("*").alias("arrivals"), F.count_if("is_duplicate").alias("duplicates"))


@q("B02_validation_reasons", O.sensor("""
SELECT event_id, arrival_seq, rejection_reason FROM labelled"""))
def _b02(c: Catalog):
    return c.sensor_batch.labelled.select("event_id", "arrival_seq", "rejection_reason")


@q("B04_temperature_status", O.sensor("SELECT event_id, temperature_c, temperature_status FROM fact"))
def _b04(c: Catalog):
    return c.sensor_batch.scored.select("event_id", "temperature_c", "temperature_status")


@q("B05_risk_score", O.sensor("SELECT event_id, risk_score FROM fact"))
def _b05(c: Catalog):
    return c.sensor_batch.scored.select("event_id", "risk_score")


@q("B08_incident_identity", O.sensor("""
SELECT sha256(event_id || '|' || incident_type) AS incident_id, event_id, incident_type FROM incidents"""))
def _b08(c: Catalog):
    return c.incidents.select("incident_id", "event_id", "incident_type")


# ------------------------------------------------------------------ H: streams

@q("H02_exact_dedupe", O.sensor("SELECT event_id, event_timestamp FROM raw"))
def _h02(c: Catalog):
    base = folder(c, "h02")
    store = TableStore(c.spark, f"{base}/tables")
    arrivals = fixtures.arrivals_from_events(sensor_stream.event_stream(c.spark, f"{c.sf_dir}/events.parquet"), c.clock)
    sensor_stream.start_exact_dedupe(arrivals, store, f"{base}/checkpoint").awaitTermination()
    return store.read("raw_sensor_events").select("event_id", "event_timestamp")


@q("H04_minute_counts_in_a_stream", O.sensor("""
SELECT strftime(event_timestamp, '%Y-%m-%dT%H:%M') AS minute, temperature_status, count(*) AS count FROM fact GROUP BY 1, 2"""))
def _h04(c: Catalog):
    """Complete-mode counts over the stored readings as a stream, kept in a table by each trigger."""
    base = folder(c, "h04")
    c.fact.write.parquet(f"{base}/fact")
    stream = c.spark.readStream.schema(c.fact.schema).parquet(f"{base}/fact")
    counts = sensor_stream.minute_status_counts(stream)
    query = (counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/counts"))
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return c.spark.read.parquet(f"{base}/counts")


@q("H07_incident_stream", O.sensor("""
SELECT sha256(event_id || '|' || incident_type) AS incident_id, incident_type, severity, shipment_id FROM incidents"""))
def _h07(c: Catalog):
    """Incidents as a stream of their own over scored readings."""
    base = folder(c, "h07")
    c.sensor_batch.scored.write.parquet(f"{base}/scored")
    stream = c.spark.readStream.schema(c.sensor_batch.scored.schema).parquet(f"{base}/scored")
    query = (incidents_of(stream, c.rules).writeStream.format("parquet").option("path", f"{base}/incidents")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return c.spark.read.parquet(f"{base}/incidents").select("incident_id", "incident_type", "severity", "shipment_id")


@q("H08_order_feed", O.sales("""
, cancelled AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem
                JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'),
returned AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem WHERE l_returnflag = 'R')
SELECT order_id, count(DISTINCT order_line_id) AS lines FROM fo WHERE order_line_id NOT IN (SELECT id FROM cancelled) GROUP BY 1
UNION ALL SELECT order_id || '-RET', count(DISTINCT order_line_id) FROM fo
WHERE order_line_id IN (SELECT id FROM returned) AND order_line_id NOT IN (SELECT id FROM cancelled) GROUP BY 1"""))
def _h08(c: Catalog):
    """Half of the lines are stored; the feed brings the others twice, then cancellations and returns, and all is replayed."""
    store = OrderStore(c.spark, folder(c, "h08"), buckets=1)
    orders = kept(c, c.orders, "h08-orders")
    store.load(orders.where("quantity % 2 = 0"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in FACT_ORDER.fields if f.name != "order_line_id"]
    inserts = orders.where("quantity % 2 = 1").select(*[f.name for f in FACT_ORDER.fields], F.lit("insert").alias("op"))
    changes = inserts.unionByName(inserts)
    for op, keys in (("cancel", fixtures.cancelled_lines(c.spark, c.sf_dir)), ("return", fixtures.returned_lines(c.spark, c.sf_dir))):
        changes = changes.unionByName(keys.select("order_line_id", *blank, F.lit(op).alias("op")))
    for _ in range(2):
        order_feed.apply_order_changes(store, changes)
    return store.read().groupBy("order_id").agg(F.count_distinct("order_line_id").alias("lines"))
