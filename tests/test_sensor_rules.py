"""Hand rows at the boundaries of the sensor rules, and pipeline invariants."""

from datetime import datetime

from pyspark.sql import functions as F

from coldlake.operators.sensor_pipeline import SensorBatch
from coldlake.schemas import RAW_SENSOR_EVENTS
from coldlake.sources import fixtures
from tests.conftest import SF_MID

T0 = datetime(2024, 1, 1, 12, 0, 0)


def _row(eid, seq=0, **kw):
    base = dict(event_id=eid, event_timestamp=T0, shipment_id="SHIP-0001", vehicle_id="V001", warehouse="North Hub",
                destination="Airport", food_category="Dairy", temperature_c=4.0, humidity_pct=50.0, latitude=19.0,
                longitude=72.8, door_open=0, battery_pct=80.0, speed_kmh=40.0, delivery_status="IN_TRANSIT",
                ingested_at=T0)
    base.update(kw)
    return base, seq


def _batch(spark, rows):
    from pyspark.sql import types as T
    data = [tuple(r[f.name] for f in RAW_SENSOR_EVENTS.fields) + (0, seq) for r, seq in rows]
    # nullable copy of the schema so hand rows may carry NULL keys
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW_SENSOR_EVENTS.fields]
                          + [T.StructField("batch_id", T.LongType()), T.StructField("arrival_seq", T.IntegerType())])
    return SensorBatch(spark.createDataFrame(data, schema))


def _by_id(df, col):
    return {r["event_id"]: r[col] for r in df.select("event_id", col).collect()}


def test_validation_reasons_first_failure_wins(spark):
    rows = [
        _row("a", shipment_id=None, vehicle_id=None), _row("b", shipment_id=""), _row("c", vehicle_id=""),
        _row("d", event_timestamp=None), _row("e", temperature_c=40.01), _row("f", temperature_c=-40.0),
        _row("g", humidity_pct=100.01), _row("h", battery_pct=-0.01), _row("i", speed_kmh=160.0),
        _row("j", speed_kmh=160.1), _row("k", latitude=90.01), _row("l", longitude=None),
        _row("m", temperature_c=float("nan")), _row("n", humidity_pct=float("nan")),
    ]
    reasons = _by_id(_batch(spark, rows).labelled, "rejection_reason")
    assert reasons == {
        "a": "null_shipment_id", "b": "null_shipment_id", "c": "null_vehicle_id", "d": "null_timestamp",
        "e": "invalid_temperature", "f": None, "g": "invalid_humidity", "h": "invalid_battery_pct", "i": None,
        "j": "invalid_speed", "k": "invalid_coordinates", "l": "invalid_coordinates", "m": "invalid_temperature",
        "n": "invalid_humidity"}


def test_temperature_status_bounds_and_default_range(spark):
    rows = [_row("lo", temperature_c=0.0), _row("hi", temperature_c=8.0), _row("w", temperature_c=13.0),
            _row("c", temperature_c=13.01), _row("w2", temperature_c=-5.0), _row("c2", temperature_c=-5.01),
            _row("u1", food_category="Unknown", temperature_c=30.0),
            _row("u2", food_category="Unknown", temperature_c=35.0),
            _row("u3", food_category=None, temperature_c=35.01)]
    st = _by_id(_batch(spark, rows).fact, "temperature_status")
    assert st == {"lo": "SAFE", "hi": "SAFE", "w": "WARNING", "c": "CRITICAL", "w2": "WARNING",
                  "c2": "CRITICAL", "u1": "SAFE", "u2": "WARNING", "u3": "CRITICAL"}


def test_risk_points_levels_and_incidents(spark):
    rows = [
        _row("s30", temperature_c=9.0),                                   # WARNING 30 -> MEDIUM
        _row("s60", temperature_c=20.0),                                  # CRITICAL 60 -> HIGH
        _row("s80", temperature_c=20.0, door_open=1, humidity_pct=80.01, battery_pct=29.0, speed_kmh=80.1),
        _row("edge", humidity_pct=80.0, battery_pct=30.0, speed_kmh=80.0),  # no points at the bounds
        _row("bat", battery_pct=14.9), _row("bat15", battery_pct=15.0),
    ]
    b = _batch(spark, rows)
    score = _by_id(b.fact, "risk_score")
    level = _by_id(b.fact, "risk_level")
    assert score == {"s30": 30.0, "s60": 60.0, "s80": 100.0, "edge": 0.0, "bat": 10.0, "bat15": 10.0}
    assert level == {"s30": "MEDIUM", "s60": "HIGH", "s80": "CRITICAL", "edge": "LOW", "bat": "LOW", "bat15": "LOW"}
    inc = {(r["event_id"], r["incident_type"]): r["severity"] for r in b.incidents.collect()}
    assert inc == {("s60", "TEMPERATURE_CRITICAL"): "HIGH", ("s60", "HIGH_RISK"): "MEDIUM",
                   ("s80", "TEMPERATURE_CRITICAL"): "HIGH", ("s80", "HIGH_RISK"): "HIGH",
                   ("s80", "DOOR_OPEN"): "MEDIUM", ("bat", "LOW_BATTERY"): "LOW"}
    texts = {r["incident_type"]: r["description"] for r in b.incidents.filter(F.col("event_id") == "s80").collect()}
    assert texts["TEMPERATURE_CRITICAL"] == "Temperature 20.0C outside safe range for Dairy."
    assert texts["HIGH_RISK"] == "Shipment risk score reached 100."


def test_invalid_first_arrival_still_claims_the_id(spark):
    rows = [_row("x", 0, humidity_pct=500.0), _row("x", 1), _row("y", 0), _row("y", 1, temperature_c=99.0)]
    b = _batch(spark, rows)
    rej = sorted((r["event_id"], r["rejection_reason"]) for r in b.rejects.collect())
    assert rej == [("x", "duplicate_event_id"), ("x", "invalid_humidity"), ("y", "duplicate_event_id")]
    assert [r["event_id"] for r in b.fact.collect()] == ["y"]


def test_null_timestamp_rows_are_skipped_in_raw_but_rejected(spark):
    b = _batch(spark, [_row("n", event_timestamp=None), _row("ok")])
    assert [r["event_id"] for r in b.raw.collect()] == ["ok"]
    assert [r["rejection_reason"] for r in b.rejects.collect()] == ["null_timestamp"]


def test_payload_keeps_nulls(spark):
    import json
    b = _batch(spark, [_row("p", vehicle_id=None)])
    payload = json.loads(b.rejects.collect()[0]["raw_payload"])
    assert "vehicle_id" in payload and payload["vehicle_id"] is None


def test_pipeline_invariants_on_fixture(spark):
    b = SensorBatch(fixtures.raw_sensor_arrivals(spark, SF_MID))
    runs = b.runs.agg(F.sum("rows_generated"), F.sum("rows_processed"), F.sum("rows_rejected"),
                      F.sum("incidents_created")).collect()[0]
    assert runs[0] == 10020 and runs[1] == 9670 and runs[2] == 350
    assert runs[1] + runs[2] == runs[0]
    assert runs[3] == b.incidents.count()
    q = b.quality
    assert q.count() == 9 * b.runs.count()
    assert q.agg(F.sum("failures")).collect()[0][0] == runs[2]
    counts = {r["rejection_reason"]: r["count"] for r in b.rejects.groupBy("rejection_reason").count().collect()}
    assert counts["duplicate_event_id"] == 20 and counts["null_timestamp"] == 11 and counts["null_vehicle_id"] == 11
    assert counts["null_shipment_id"] == 22 and counts["invalid_battery_pct"] == 11
    assert counts["invalid_coordinates"] == 11
    # quality score floor: nine checks per row, so one failure per row keeps the score above 88.8
    worst = q.groupBy("run_id").agg((100 - F.sum("failures") / F.sum("records_checked") * 100).alias("s"))
    assert worst.agg(F.min("s")).collect()[0][0] > 88.8
