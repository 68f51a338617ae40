"""Hot keys: one event_id or one customer holding a third of all rows stays correct, and the
plans reduce such groups with partial aggregation instead of windowing the raw rows."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.operators import sales_customers as SC
from coldlake.operators.sensor_pipeline import SensorBatch, _arrival_groups
from coldlake.schemas import FACT_ORDER, RAW_SENSOR_EVENTS


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_event_id_replays(spark):
    n = 3000
    base = dict(event_timestamp=datetime(2024, 1, 1), shipment_id="SHIP-0001", vehicle_id="V001",
                warehouse="North Hub", destination="Airport", food_category="Dairy", temperature_c=4.0,
                humidity_pct=50.0, latitude=19.0, longitude=72.8, door_open=0, battery_pct=80.0, speed_kmh=40.0,
                delivery_status="IN_TRANSIT", ingested_at=datetime(2024, 1, 1))
    rows = []
    for i in range(n):
        eid = "HOT" if i % 3 == 0 else f"E{i}"     # a third of all arrivals share one id
        run = 0 if i % 3 == 0 else i % 5
        rows.append(tuple({**base, "event_id": eid}[f.name] for f in RAW_SENSOR_EVENTS.fields) + (run, i))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW_SENSOR_EVENTS.fields]
                          + [T.StructField("batch_id", T.LongType()), T.StructField("arrival_seq", T.IntegerType())])
    b = SensorBatch(spark.createDataFrame(rows, schema).repartition(8))
    assert b.fact.count() == 1 + 2 * n // 3
    dups = b.rejects.filter(F.col("rejection_reason") == "duplicate_event_id").count()
    assert dups == n // 3 - 1
    # the first exchange deals the hot key by input split, the second only brings split firsts together
    plan = _plan(b.labelled)
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert len(exchanges) == 2 and "_meet" in exchanges[0] and "_split" in exchanges[1] and "Join" not in plan
    for by, most in ((["batch_id", "event_id", "_split"], n // 3 // 4), (["batch_id", "event_id", "_meet"], 64)):
        groups = _arrival_groups(b.arrivals, 32).groupBy(*by).count().agg(F.max("count")).first()[0]
        assert groups <= most, by


def test_null_and_equal_arrivals_are_counted(spark):
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW_SENSOR_EVENTS.fields]
                          + [T.StructField("batch_id", T.LongType()), T.StructField("arrival_seq", T.IntegerType())])
    names = [f.name for f in RAW_SENSOR_EVENTS.fields]
    made = [{"event_id": e, "event_timestamp": ts, "shipment_id": "S", "vehicle_id": "V", "temperature_c": 4.0, "humidity_pct": 50.0, "latitude": 1.0, "longitude": 1.0,
             "battery_pct": 50.0, "speed_kmh": 10.0} for e, ts in ((None, datetime(2024, 1, 1)), (None, datetime(2024, 1, 2)), ("A", datetime(2024, 1, 1)), ("A", datetime(2024, 1, 1)),
                                                                  ("A", datetime(2024, 1, 1)), ("B", None), ("B", datetime(2024, 1, 3)))]
    b = SensorBatch(spark.createDataFrame([tuple(r.get(n) for n in names) + (7, 0) for r in made], schema).repartition(3))
    run = b.runs.first()
    assert (run["rows_generated"], run["rows_processed"] + run["rows_rejected"]) == (7, 7)
    assert b.rejects.filter("rejection_reason = 'duplicate_event_id'").count() == 4
    assert sorted(r["event_id"] for r in b.raw.collect()) == ["A", "B"]


def test_freshness_of_no_readings_is_null(spark):
    from coldlake.operators import ops_reports as R
    from coldlake.operators import ops_view as V
    from coldlake.schemas import DATA_QUALITY_RESULTS, FACT_SENSOR_READING, PIPELINE_RUNS

    fact, runs, quality = (spark.createDataFrame([], s) for s in (FACT_SENSOR_READING, PIPELINE_RUNS, DATA_QUALITY_RESULTS))
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    assert R.data_freshness_seconds(fact, now).first()[0] is None
    assert V.status_labels(fact, runs, quality, now).first()["freshness_label"] is None


def test_hot_customer_in_customer_reports(spark):
    rows = []
    for i in range(3000):
        cust = "HOT" if i % 3 == 0 else f"C{i % 50}"
        d = date(2024, 1 + (i % 6), 1 + (i % 28))
        rows.append((f"L{i}", f"O{i}", d, cust, "P1", "West", "S", "C", "Online", "Dairy", 1, 1.0, 0.0,
                     Decimal("1.00"), Decimal("0"), Decimal("1.00"), Decimal("0.50"), 12))
    df = spark.createDataFrame(rows, FACT_ORDER).repartition(8)
    nr = {r["period"]: r["new"] + r["returning"] for r in SC.new_vs_returning(df).collect()}
    assert sum(nr.values()) == 3000
    ret = {r["period"]: r["retention"] for r in SC.retention_rate(df).collect()}
    active: dict[str, set] = {}
    for r in rows:
        active.setdefault(r[2].strftime("%Y-%m"), set()).add(r[3])
    months = sorted(active)
    brute = {months[0]: 0.0}
    for prev, cur in zip(months, months[1:]):
        brute[cur] = round(len(active[prev] & active[cur]) / len(active[prev]) * 100, 1)
    assert ret == brute
    for out in (SC.new_vs_returning(df), SC.retention_rate(df), SC.cohort_retention(df)):
        out.collect()
        plan = _plan(out)
        # the per-customer window sits above a partial (map-side) aggregate to (customer, month)
        assert "partial_count" in plan or "partial_" in plan


def test_stored_event_tables_join_without_a_shuffle(spark):
    """C19, C31, C33 over the bucketed tables: only the small aggregate is exchanged."""
    from coldlake.operators import ops_reports as R
    from coldlake.plans.catalog import SENSOR_TABLES, Catalog
    from tests.conftest import SF_SMALL

    stored, lazy = Catalog(spark, SF_SMALL), Catalog(spark, SF_SMALL)
    stored.materialize(SENSOR_TABLES)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = R.with_event_warehouse(stored.fact, stored.raw)
        joined.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning(event_id" not in plan
        got = sorted(map(tuple, R.warehouse_comparison(stored.fact, stored.raw).collect()))
        assert "Exchange hashpartitioning(event_id" not in R.status_by_warehouse(stored.fact, stored.raw)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == sorted(map(tuple, R.warehouse_comparison(lazy.fact, lazy.raw).collect()))
