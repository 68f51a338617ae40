"""Table store protocol (A3-A6, A10-A13) and batch/stream equality (H1, H2, H9)."""

import os
import time

import pytest
from pyspark.sql import functions as F

from coldlake.operators import maintenance as M
from coldlake.operators.sensor_pipeline import SensorBatch
from coldlake.sources import fixtures
from coldlake.sources.epochs import EpochStore
from coldlake.sources.order_store import OrderStore
from coldlake.sources.tables import SchemaMismatch, TableStore, export_csv, load_checked, schema_matches
from coldlake.streaming.order_feed import apply_order_changes
from coldlake.streaming.sensor_stream import commit_sensor_batch, event_stream, start_exact_dedupe, start_sensor_pipeline
from tests.conftest import SF_SMALL


def test_missing_table_reads_empty_with_schema(spark, scratch):
    store = TableStore(spark, scratch)
    df = store.read("fact_order")
    assert df.count() == 0 and schema_matches(df, "fact_order")


def test_insert_if_absent_is_idempotent(spark, scratch):
    store = EpochStore(spark, scratch)
    arrivals = fixtures.raw_sensor_arrivals(spark, SF_SMALL)
    assert commit_sensor_batch(store, arrivals)
    counts = {n: store.read(n).count() for n in ("raw_sensor_events", "fact_sensor_reading", "fact_incident",
                                                 "rejected_events", "pipeline_runs", "data_quality_results")}
    assert not commit_sensor_batch(store, arrivals)          # a replayed batch changes nothing
    again = {n: store.read(n).count() for n in counts}
    assert counts == again
    assert counts["fact_sensor_reading"] == 952 and counts["pipeline_runs"] == 2
    assert counts["data_quality_results"] == 18


def test_stream_equals_batch(spark, scratch):
    store = EpochStore(spark, os.path.join(scratch, "tables"))
    q = start_sensor_pipeline(spark, f"{SF_SMALL}/events.parquet", store, os.path.join(scratch, "ckpt"),
                              available_now=True)
    q.awaitTermination(300)
    batch = SensorBatch(fixtures.raw_sensor_arrivals(spark, SF_SMALL))
    cols = ["event_id", "temperature_status", "risk_score", "risk_level"]
    assert sorted(store.read("fact_sensor_reading").select(*cols).collect()) == sorted(batch.fact.select(*cols).collect())
    assert store.read("rejected_events").count() == batch.rejects.count()


def test_stream_over_parts_loses_nothing(spark, scratch):
    """A folder of parts in several micro-batches, newest first: nothing is lost, replays are stored once."""
    src = os.path.join(scratch, "events.parquet")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.orderBy(F.col("ts").desc()).repartitionByRange(3, F.col("ts").desc()).write.parquet(src)
    events.filter("event_id < 40").coalesce(1).write.mode("append").parquet(src)       # replays of an earlier batch
    store = EpochStore(spark, os.path.join(scratch, "tables"))
    start_sensor_pipeline(spark, src, store, os.path.join(scratch, "ckpt"), max_files_per_trigger=1,
                          available_now=True).awaitTermination(600)
    whole = SensorBatch(fixtures.raw_sensor_arrivals(spark, SF_SMALL))
    assert sorted(r[0] for r in store.read("fact_sensor_reading").select("event_id").collect()) == sorted(
        r[0] for r in whole.fact.select("event_id").collect())
    runs = store.read("pipeline_runs").collect()
    arrived = fixtures.arrivals_from_events(spark.read.parquet(src)).count()
    assert len(runs) == 4 and sum(r["rows_generated"] for r in runs) == arrived
    assert all(r["rows_processed"] + r["rows_rejected"] == r["rows_generated"] for r in runs)
    assert all(r["started_at"].year >= 2025 for r in runs)                              # the trigger's time
    deduped = TableStore(spark, os.path.join(scratch, "dedupe"))
    stream = fixtures.arrivals_from_events(event_stream(spark, src, max_files_per_trigger=1))
    start_exact_dedupe(stream, deduped, os.path.join(scratch, "ckpt2")).awaitTermination(600)
    assert deduped.read("raw_sensor_events").count() == whole.raw.count()


def test_stream_without_events_fails(spark, scratch):
    path = os.path.join(scratch, "none")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(0).write.parquet(path)
    with pytest.raises(FileNotFoundError):
        event_stream(spark, path)


def test_a_new_process_finds_the_newest_snapshot(spark, scratch):
    store = TableStore(spark, f"file://{scratch}")
    dims = fixtures.dim_vehicle(spark)
    for n in (3, 5):
        store.commit("dim_vehicle", dims.limit(n))
    assert TableStore(spark, f"file://{scratch}").read("dim_vehicle").count() == 5


def test_kept_row_is_the_first_by_order_then_content(spark, scratch):
    store = TableStore(spark, scratch)
    rows = [("V1", "b", "x", 2.0, 1), ("V1", "a", "x", 1.0, 1), ("V1", "0", "x", 0.0, 2), (None, "a", "x", 1.0, 0)]
    new = spark.createDataFrame(rows, "vehicle_id string, vehicle_type string, refrigeration_type string, capacity_kg double, seq int")
    store.insert_if_absent("dim_vehicle", new.repartition(3), "seq")
    assert [tuple(r) for r in store.read("dim_vehicle").collect()] == [("V1", "a", "x", 1.0)]


def test_order_feed_takes_the_last_change_of_a_line(spark, scratch):
    store = OrderStore(spark, scratch, buckets=3)
    names = "order_line_id string, op string, seq int, order_id string, quantity int, revenue decimal(15,2)"
    changes = [("a", "insert", 1, "O1", 1, None), ("a", "insert", 2, "O1", 7, None), ("b", "insert", 1, "O2", 2, None), ("b", "cancel", 2, None, None, None),
               ("c", "cancel", 1, None, None, None), ("c", "insert", 2, "O3", 3, None), ("c", "return", 3, None, None, None),
               ("d", "insert", 1, "O4", 4, None), ("d", "return", 2, None, None, None), ("d", "cancel", 3, None, None, None), ("e", "return", 1, None, None, None)]
    feed = spark.createDataFrame(changes, names)
    for _ in range(2):                                                                  # a replay changes nothing
        apply_order_changes(store, feed)
        assert sorted((r["order_id"], r["quantity"]) for r in store.read().collect()) == [("O1", 7), ("O3", 3), ("O3-RET", -3)]


def test_upsert_delete_returns_purge_and_csv(spark, scratch):
    store = TableStore(spark, scratch)
    orders = fixtures.fact_order(spark, SF_SMALL)
    store.commit("fact_order", orders)
    n = store.count("fact_order").collect()[0]["rows"]
    cancelled = fixtures.cancelled_lines(spark, SF_SMALL)
    store.delete_keys("fact_order", cancelled)
    n_cancel = cancelled.distinct().count()
    assert store.count("fact_order").collect()[0]["rows"] == n - n_cancel
    ret = fixtures.returned_lines(spark, SF_SMALL)
    once = M.apply_returns(store.read("fact_order"), ret)
    twice = M.apply_returns(once, ret)
    assert once.count() == twice.count()
    neg = once.filter(F.col("order_id").endswith("-RET"))
    assert neg.filter((F.col("revenue") > 0) | (F.col("quantity") > 0)).count() == 0
    store.upsert("fact_order", neg)
    assert store.read("fact_order").filter(F.col("order_id").endswith("-RET")).count() == neg.count()
    kept = M.purge_before(store.read("fact_order"), F.to_date(F.lit("1998-01-01")))
    assert kept.filter(F.col("order_date") < "1998-01-01").count() == 0
    out = os.path.join(scratch, "csv")
    export_csv(kept.limit(5), out)
    assert any(f.endswith(".csv") for f in os.listdir(out))


def test_windowed_counts_in_a_stream_equal_batch_report(spark, scratch):
    from coldlake.operators import ops_reports as R
    from coldlake.streaming.sensor_stream import latest_position, minute_status_counts

    fact = SensorBatch(fixtures.raw_sensor_arrivals(spark, SF_SMALL)).fact
    src = os.path.join(scratch, "fact")
    fact.write.parquet(src)
    stream = spark.readStream.schema(fact.schema).parquet(src)
    q1 = (minute_status_counts(stream).writeStream.outputMode("complete").format("memory")
          .queryName("h3_counts").trigger(availableNow=True).start())
    q2 = (latest_position(stream).writeStream.outputMode("complete").format("memory")
          .queryName("h6_latest").trigger(availableNow=True).start())
    q1.awaitTermination(300)
    q2.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.table("h3_counts").collect())
    want = sorted(tuple(r) for r in R.status_over_time(spark.read.parquet(src)).collect())
    assert got == want
    got6 = sorted(tuple(r) for r in spark.table("h6_latest").collect())
    want6 = sorted(tuple(r) for r in R.latest_vehicle_locations(spark.read.parquet(src)).collect())
    assert got6 == want6


def test_seed_master_data_keeps_existing_rows(spark, scratch):
    store = TableStore(spark, scratch)
    dims = fixtures.dim_shipment(spark, SF_SMALL)
    M.seed_master_data(store, fixtures.dim_vehicle(spark), dims)
    changed = dims.withColumn("warehouse", F.lit("Elsewhere"))
    M.seed_master_data(store, fixtures.dim_vehicle(spark), changed)
    assert store.read("dim_shipment").filter(F.col("warehouse") == "Elsewhere").count() == 0
    assert store.read("dim_vehicle").count() == 30


def test_watermark_drops_and_reports_late_rows(spark, scratch):
    from datetime import datetime, timedelta

    from coldlake.streaming.sensor_stream import LateRows, minute_status_counts

    schema = "event_id string, event_timestamp timestamp, temperature_status string"
    t0 = datetime(2024, 1, 1, 12, 0, 0)
    src = os.path.join(scratch, "late")
    spark.createDataFrame([(f"a{i}", t0 + timedelta(minutes=30 + i), "SAFE") for i in range(5)], schema) \
        .coalesce(1).write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame([(f"b{i}", t0 + timedelta(minutes=40 + i), "SAFE") for i in range(2)], schema) \
        .coalesce(1).write.parquet(os.path.join(src, "b2"))
    # late rows arrive in a third micro-batch: late-event filtering uses the previous batch's watermark
    spark.createDataFrame([(f"c{i}", t0 + timedelta(minutes=i), "SAFE") for i in range(3)], schema) \
        .coalesce(1).write.parquet(os.path.join(src, "b3"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    late = LateRows()
    spark.streams.addListener(late)
    q = (minute_status_counts(stream, watermark="1 minute").writeStream.outputMode("append").format("memory")
         .queryName("late_counts").trigger(availableNow=True).start())
    q.awaitTermination(300)
    for _ in range(100):                                                                # listeners are told in the background
        if late.dropped[str(q.id)] == 3:
            break
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert late.dropped[str(q.id)] == 3


def test_two_writers_of_one_version(spark, scratch):
    """The second of two writers that start from one version fails instead of hiding the first."""
    a, b = TableStore(spark, scratch), TableStore(spark, scratch)
    dims = fixtures.dim_vehicle(spark)
    a.commit("dim_vehicle", dims.limit(3))
    b._version = lambda name, seen=b._version("dim_vehicle") - 1: seen
    with pytest.raises(Exception):
        b.commit("dim_vehicle", dims.limit(5))
    assert a.read("dim_vehicle").count() == 3 and TableStore(spark, scratch).read("dim_vehicle").count() == 3


def test_checked_load(spark, scratch):
    path = os.path.join(scratch, "v")
    assert load_checked(spark, "dim_vehicle", path).count() == 0
    dims = fixtures.dim_vehicle(spark)
    dims.drop("vehicle_type").write.parquet(path)
    assert load_checked(spark, "dim_vehicle", path).where("vehicle_type is null").count() == 30
    for k, wrong in enumerate((dims.drop("vehicle_id"), dims.withColumn("capacity_kg", F.lit("x")))):
        wrong.write.parquet(f"{path}{k}")
        with pytest.raises(SchemaMismatch):
            load_checked(spark, "dim_vehicle", f"{path}{k}")


def test_sample_is_the_same_under_any_partitioning(spark):
    lines = fixtures.fact_order(spark, SF_SMALL).select("order_line_id")
    a, b = (sorted(r[0] for r in M.random_sample(lines.repartition(n), 40).collect()) for n in (1, 13))
    assert a == b and len(a) == 40 and a != sorted(r[0] for r in M.random_sample(lines, 40, seed=7).collect())
