"""Declared schemas of the eleven tables (bronze, silver, run logs and sales)."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


S, D, TS, DT, I, L = T.StringType(), T.DoubleType(), T.TimestampType(), T.DateType(), T.IntegerType(), T.LongType()

RAW_SENSOR_EVENTS = _s(
    ("event_id", S, False), ("event_timestamp", TS, False), ("shipment_id", S, True), ("vehicle_id", S, True),
    ("warehouse", S, True), ("destination", S, True), ("food_category", S, True), ("temperature_c", D, True),
    ("humidity_pct", D, True), ("latitude", D, True), ("longitude", D, True), ("door_open", I, True),
    ("battery_pct", D, True), ("speed_kmh", D, True), ("delivery_status", S, True), ("ingested_at", TS, True),
)

DIM_VEHICLE = _s(("vehicle_id", S, False), ("vehicle_type", S, True), ("refrigeration_type", S, True),
                 ("capacity_kg", D, True))

DIM_SHIPMENT = _s(
    ("shipment_id", S, False), ("food_category", S, True), ("warehouse", S, True), ("destination", S, True),
    ("required_min_temp", D, True), ("required_max_temp", D, True), ("created_at", TS, True),
)

FACT_SENSOR_READING = _s(
    ("event_id", S, False), ("event_timestamp", TS, False), ("shipment_id", S, True), ("vehicle_id", S, True),
    ("temperature_c", D, True), ("humidity_pct", D, True), ("latitude", D, True), ("longitude", D, True),
    ("door_open", I, True), ("battery_pct", D, True), ("speed_kmh", D, True), ("temperature_status", S, True),
    ("risk_score", D, True), ("risk_level", S, True), ("anomaly_flag", I, True), ("processed_at", TS, True),
)

FACT_INCIDENT = _s(
    ("incident_id", S, False), ("event_id", S, True), ("shipment_id", S, True), ("vehicle_id", S, True),
    ("incident_type", S, True), ("severity", S, True), ("incident_timestamp", TS, True), ("description", S, True),
)

REJECTED_EVENTS = _s(("rejection_id", S, False), ("event_id", S, True), ("rejection_reason", S, True),
                     ("raw_payload", S, True), ("rejected_at", TS, True))

PIPELINE_RUNS = _s(
    ("run_id", S, False), ("started_at", TS, True), ("finished_at", TS, True), ("rows_generated", L, True),
    ("rows_processed", L, True), ("rows_rejected", L, True), ("incidents_created", L, True), ("status", S, True),
)

DATA_QUALITY_RESULTS = _s(
    ("quality_id", S, False), ("run_id", S, True), ("check_name", S, True), ("records_checked", L, True),
    ("failures", L, True), ("status", S, True), ("created_at", TS, True),
)

DIM_CUSTOMER = _s(
    ("customer_id", S, False), ("customer_name", S, True), ("region", S, True), ("state", S, True),
    ("city", S, True), ("acquisition_channel", S, True), ("first_order_date", DT, True),
)

DIM_PRODUCT = _s(("product_id", S, False), ("product_name", S, True), ("category", S, True),
                 ("unit_cost", D, True), ("list_price", D, True))

MONEY = T.DecimalType(15, 2)

FACT_ORDER = _s(
    ("order_line_id", S, False), ("order_id", S, True), ("order_date", DT, True), ("customer_id", S, True),
    ("product_id", S, True), ("region", S, True), ("state", S, True), ("city", S, True), ("channel", S, True),
    ("category", S, True), ("quantity", I, True), ("unit_price", D, True), ("discount_pct", D, True),
    ("revenue", MONEY, True), ("cost", MONEY, True), ("gross_profit", MONEY, True), ("net_profit", MONEY, True),
    ("hour", I, True),
)

TABLES: dict[str, T.StructType] = {
    "raw_sensor_events": RAW_SENSOR_EVENTS,
    "dim_vehicle": DIM_VEHICLE,
    "dim_shipment": DIM_SHIPMENT,
    "fact_sensor_reading": FACT_SENSOR_READING,
    "fact_incident": FACT_INCIDENT,
    "rejected_events": REJECTED_EVENTS,
    "pipeline_runs": PIPELINE_RUNS,
    "data_quality_results": DATA_QUALITY_RESULTS,
    "dim_customer": DIM_CUSTOMER,
    "dim_product": DIM_PRODUCT,
    "fact_order": FACT_ORDER,
}

# Primary keys (insert-if-absent and upsert use them).
KEYS: dict[str, list[str]] = {
    "raw_sensor_events": ["event_id"],
    "dim_vehicle": ["vehicle_id"],
    "dim_shipment": ["shipment_id"],
    "fact_sensor_reading": ["event_id"],
    "fact_incident": ["incident_id"],
    "rejected_events": ["rejection_id"],
    "pipeline_runs": ["run_id"],
    "data_quality_results": ["quality_id"],
    "dim_customer": ["customer_id"],
    "dim_product": ["product_id"],
    "fact_order": ["order_line_id"],
}


def not_null_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]
