"""Epoch store, folded tables, keyed sinks and the order store: crashes, replays, merging, untouched files."""

import hashlib
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.operators import live_reports, ops_reports as R
from coldlake.operators.sensor_pipeline import SensorBatch
from coldlake.schemas import FACT_ORDER
from coldlake.sources import fixtures
from coldlake.sources.epochs import EpochLog, EpochStore, FoldedTable, KeyedSink
from coldlake.sources.order_store import OrderStore
from coldlake.streaming.order_feed import apply_order_changes
from coldlake.streaming.sensor_stream import TrailingMinute, commit_sensor_batch
from tests.conftest import SF_SMALL

TABLES = ("raw_sensor_events", "fact_sensor_reading", "fact_incident", "rejected_events", "pipeline_runs", "data_quality_results")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def state(store, head=None):
    return {n: rows(store.read(n, head)) for n in TABLES} | {g: rows(store.partial(g, head)) for g in store.grains}


def test_a_batch_is_visible_as_a_whole_or_not_at_all(spark, scratch):
    arrivals = fixtures.raw_sensor_arrivals(spark, SF_SMALL)
    first, second = arrivals.where("batch_id = 0"), arrivals.where("batch_id = 1")
    store = EpochStore(spark, scratch, fold=2)
    assert all(v == [] for v in state(store).values())
    commit_sensor_batch(store, first, 0)
    old = state(store)
    for die_at in (1, 3, 9, 14):
        seen = []

        def dies(name):
            seen.append(name)
            if len(seen) == die_at:
                raise RuntimeError(name)
        with pytest.raises(RuntimeError):
            commit_sensor_batch(store, second, 1, after=dies)
        if die_at in (3, 14):
            assert state(EpochStore(spark, scratch, fold=2)) == old
    assert commit_sensor_batch(store, second, 1)
    whole = SensorBatch(arrivals)
    assert rows(store.read("fact_sensor_reading")) == rows(whole.fact)
    assert store.read("rejected_events").count() == whole.rejects.count()
    assert not commit_sensor_batch(store, second, 1) and store.log.head() == 1
    new = state(store)
    # an epoch that failed and never came again is forgotten by the next one
    with pytest.raises(RuntimeError):
        commit_sensor_batch(store, second, 2, after=lambda name: (_ for _ in ()).throw(RuntimeError(name)))
    commit_sensor_batch(store, second.limit(0), 5)
    assert {n: state(store)[n] for n in TABLES} == {n: new[n] for n in TABLES}
    with pytest.raises(Exception):
        store.log.publish(5)                                     # another writer's marker is there


def test_equal_arrivals_are_all_kept_as_rejections(spark, scratch):
    arrivals = fixtures.raw_sensor_arrivals(spark, SF_SMALL)
    one = arrivals.where("event_id = 'E17'")
    store = EpochStore(spark, scratch)
    commit_sensor_batch(store, one.unionByName(one).unionByName(one).repartition(2), 0)
    run = store.read("pipeline_runs").first()
    kept = store.read("rejected_events").collect()
    assert run["rows_rejected"] == len(kept) == len({r["rejection_id"] for r in kept}) == 2
    assert store.read("fact_sensor_reading").count() == 1


def test_reports_from_partials_over_many_epochs(spark, scratch):
    """Seven epochs, a snapshot every third: the reports equal those over the readings, and read one snapshot."""
    arrivals = fixtures.raw_sensor_arrivals(spark, SF_SMALL).withColumn("batch_id", F.pmod(F.xxhash64("event_id"), F.lit(7)))
    store = EpochStore(spark, scratch, fold=3)
    for k in range(7):
        commit_sensor_batch(store, arrivals.where(F.col("batch_id") == k), k, one_run=True)
    fact, runs, quality = (store.read(n) for n in ("fact_sensor_reading", "pipeline_runs", "data_quality_results"))
    dims = fixtures.dim_shipment(spark, SF_SMALL)
    live = live_reports.LiveReports(store)
    for mine, want in ((live.top_kpis(), R.top_kpis(fact)), (live.vehicle_health(), R.vehicle_health(fact)), (live.shipment_health(), R.shipment_health(fact)),
                       (live.risk_by_warehouse(dims), R.risk_by_warehouse(fact, dims)), (live.status_over_time(), R.status_over_time(fact)),
                       (live.pipeline_health(), R.pipeline_health(runs)), (live.data_quality_summary(), R.data_quality_summary(quality)),
                       (live.sensor_correlation_matrix(), R.sensor_correlation_matrix(fact)), (live.latest_vehicle_locations(), R.latest_vehicle_locations(fact)),
                       (live.second_kpis(), R.second_kpis(fact, store.read("fact_incident"), runs, quality)), (live.system_health_score(), R.system_health_score(fact, runs, quality))):
        assert rows(mine.select(*want.columns)) == rows(want)
    for t in store.folded.values():
        assert sorted(t.folder.names()) == ["base=3", "base=6"]
        assert {r["epoch"] for r in t.stored(6).collect()} <= {-1, 6}


def test_reports_of_an_empty_store(spark, scratch):
    live = live_reports.LiveReports(EpochStore(spark, scratch))
    assert live.top_kpis().first()["total_readings"] == 0 and live.system_health_score().first()[0] == 0.0
    assert live.pipeline_health().first()["last_run_status"] == "N/A" and live.status_over_time().count() == 0


def test_folded_table_overwrites_a_failed_epoch(spark, scratch):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    t = FoldedTable(spark, scratch, schema, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), fold=2)
    log = EpochLog(spark, scratch)
    put = lambda e, n: t.write(e, spark.createDataFrame([("a", n)], schema), log.head())
    total = 0
    for e in range(5):
        put(e, 1000)                                             # fails before it is published
        assert [r["n"] for r in t.read(log.head()).collect()] == ([total] if total else [])
        put(e, e + 1)
        log.publish(e)
        total += e + 1
        assert t.read(log.head()).first()["n"] == total
    assert len(EpochLog(spark, scratch).folder.names("_published")) <= 8


def test_keyed_sink_takes_the_newest_version_once(spark, scratch):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    sink = KeyedSink(spark, scratch, schema, ["k"], fold=2)
    frame = lambda *r: spark.createDataFrame(list(r), schema)
    assert sink.read().count() == 0
    assert sink.put(frame(("a", 1), ("b", 1), (None, 1)), 0) and sink.put(frame(("a", 0)), 1) and sink.put(frame(), 3) and sink.put(frame(("b", None)), 4)
    assert not sink.put(frame(("a", 9), ("z", 9)), 1)             # replayed
    assert rows(KeyedSink(spark, scratch, schema, ["k"], fold=2).read()) == [("a", 0), ("b", None), (None, 1)]


def test_trailing_minute_forgets(spark, scratch):
    t0 = datetime(2024, 1, 1, 12)
    frame = lambda *s: spark.createDataFrame([(t0 + timedelta(seconds=x), float(x)) for x in s], "event_timestamp timestamp, risk_score double")
    state = TrailingMinute(spark, scratch, fold=2)
    for epoch, seconds in enumerate([(0, 30, 59), (60,), (10,), (), (500, 455, 440)]):
        state.put(frame(*seconds), epoch)
    state.put(frame(9999), 2)                                    # replayed
    got = [(r["latest_event_timestamp"], r["readings"], r["avg_risk"]) for r in state.history().orderBy("at_epoch").collect()]
    at = lambda s: t0 + timedelta(seconds=s)
    assert got == [(at(59), 3, 89 / 3), (at(60), 3, 149 / 3), (at(60), 4, 159 / 4), (at(60), 4, 159 / 4), (at(500), 2, 955 / 2)]
    assert state.seconds.read(4).count() == 2


def orders(spark, rows_):
    blank = {f.name: F.lit(None).cast(f.dataType) for f in FACT_ORDER.fields}
    df = spark.createDataFrame(rows_, "order_line_id string, order_id string, order_date date, quantity int, revenue decimal(15,2)")
    return df.select(*[F.col(c) if c in df.columns else e.alias(c) for c, e in blank.items()])


def files(store):
    return {(r["order_month"], r["bucket"], r["file"]) for r in store.files().collect()}


def test_changes_touch_their_partitions_only(spark, scratch):
    day = lambda m, d=5: datetime(2024, m, d).date()
    store = OrderStore(spark, scratch, buckets=4)
    store.load(orders(spark, [(f"L{k}", f"O{k}", day(1 + k % 6), k, None) for k in range(240)] + [("nodate", "O", None, 1, None)]))
    before = files(store)
    store.cancel(spark.createDataFrame([("L0",), ("absent",)], "order_line_id string"))
    gone = before - files(store)
    assert {m for m, _, _ in gone} == {"2024-01"} and len({b for _, b, _ in gone}) == 1 and store.read().count() == 240
    now = files(store)
    store.upsert(orders(spark, [("L1", "O1", day(3), 99, None), ("new", "N", day(9), 1, None)]))     # L1 moves from February to March
    assert {m for m, _, _ in now - files(store)} <= {"2024-02", "2024-03"}
    assert rows(store.read().where("order_line_id = 'L1'").select("order_date", "quantity")) == [(day(3), 99)]
    assert store.read().count() == 241
    store.purge_before("2024-04-06")
    left = [r["order_date"] for r in store.read().collect()]
    assert sorted({d.month for d in left if d}) == [5, 6, 9] and None in left
    assert not any(n.endswith(("2024-01", "2024-02", "2024-03")) for n in store.folder.names("lines"))
    assert [n for n in store.folder.names() if n.startswith("work")] == []
    with pytest.raises(ValueError):
        store.load(orders(spark, []))


def test_a_partition_that_loses_all_rows_is_deleted(spark, scratch):
    store = OrderStore(spark, scratch, buckets=1)
    store.load(orders(spark, [("a", "A", datetime(2024, 1, 1).date(), 1, None), ("b", "B", datetime(2024, 2, 1).date(), 1, None)]))
    store.cancel(spark.createDataFrame([("a",)], "order_line_id string"))
    assert rows(store.read().select("order_line_id")) == [("b",)] and "bucket=0" not in store.folder.names("lines", "order_month=2024-01")


def test_feed_returns_lines_in_their_month(spark, scratch):
    store = OrderStore(spark, scratch, buckets=5)
    store.load(orders(spark, [(f"L{k}", f"O{k}", datetime(2024, 1 + k, 1).date(), 3, None) for k in range(4)]))
    feed = orders(spark, [("X", "OX", datetime(2024, 8, 1).date(), 4, None)]).withColumn("op", F.lit("insert"))
    for key, op in (("L1", "return"), ("X", "return"), ("L3", "cancel"), ("L3", "return")):
        feed = feed.unionByName(orders(spark, [(key, None, None, None, None)]).withColumn("op", F.lit(op)))
    for _ in range(2):
        apply_order_changes(store, feed)
        assert sorted((r["order_id"], r["order_date"].month, r["quantity"]) for r in store.read().collect()) == [
            ("O0", 1, 3), ("O1", 2, 3), ("O1-RET", 2, -3), ("O2", 3, 3), ("OX", 8, 4), ("OX-RET", 8, -4)]


def test_months(spark, scratch):
    store = OrderStore(spark, os.path.join(scratch, "none"), buckets=2)
    assert store.read().count() == 0
    store.upsert(orders(spark, [("a", "A", datetime(2023, 12, 1).date(), 1, None), ("b", "B", datetime(2024, 2, 1).date(), 1, None)]))
    assert rows(store.months("2024-01").select("order_line_id")) == [("b",)]


def test_a_micro_batch_is_dealt_over_several_files(spark, scratch):
    """Every number is one micro-batch of several files, also one that has fewer rows than files."""
    from coldlake.plans.registry_live import written
    rows = spark.range(600).select("id", F.when(F.col("id") < 397, 0).when(F.col("id") < 400, 1).otherwise(2).alias("k"))
    path, parts = written(rows, F.col("k"), 3, os.path.join(scratch, "dealt"), rows_a_file=50)
    assert parts == min(4, spark.sparkContext.defaultParallelism) > 1
    held = spark.read.parquet(path).groupBy("k", F.col("_metadata.file_name").alias("f")).count().collect()
    assert sum(r["count"] for r in held) == 600
    assert len([r for r in held if r["k"] == 0]) == len([r for r in held if r["k"] == 2]) == parts
    seen = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(path)
    (stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted((r["k"], r["count"]) for r in df.groupBy("k").count().collect())) and None)
     .option("checkpointLocation", os.path.join(scratch, "seen")).trigger(availableNow=True).start().awaitTermination())
    assert seen == [[(0, 397)], [(1, 3)], [(2, 200)]]


def test_a_rewrite_writes_its_rows_once(spark, scratch):
    """No copy of the changed rows lies beside the table; partitions that lose all rows go."""
    orders = fixtures.fact_order(spark, SF_SMALL).limit(200).persist()
    store = OrderStore(spark, scratch, buckets=1)
    store.load(orders)
    written, delete = [], store.folder.delete
    store.folder.delete = lambda *parts: (written.extend(store.folder.names(*parts)), delete(*parts))
    first = store.read().agg(F.min(F.date_format("order_date", "yyyy-MM"))).first()[0]
    gone = orders.where(F.date_format("order_date", "yyyy-MM") == first)
    n = gone.count()
    store.cancel(gone.select("order_line_id"))
    orders.unpersist()
    assert store.read().count() == 200 - n and f"order_month={first}" not in {r[0] for r in store.files().select("order_month").collect()}
    assert "touched" in written and "rows" not in written


def test_whole_rows_are_not_shuffled_by_a_change(spark, scratch, monkeypatch):
    """Load and rewrite write rows where they are read; replaced rows are marked by their place, also among many of one file."""
    plans, write = [], OrderStore._write
    monkeypatch.setattr(OrderStore, "_write", lambda self, placed: (plans.append(placed._jdf.queryExecution().executedPlan().toString()), write(self, placed))[1])
    day = datetime(2024, 1, 1).date()
    store = OrderStore(spark, scratch, buckets=1)
    lines = spark.range(0, 40_000, 1, 1).select(F.concat(F.lit("L"), F.col("id")).alias("order_line_id"), F.lit(day).alias("order_date"), F.col("id").cast("int").alias("quantity"))
    store.load(lines)
    new = lines.where("quantity % 1000 in (0, 7, 8, 999) or quantity in (32767, 32768)").withColumns({"quantity": -F.col("quantity") - 1, "order_date": F.lit(datetime(2024, 3, 1).date())})
    store.upsert(new)
    got = store.read()
    assert got.count() == 40_000 and got.where("quantity < 0").count() == new.count() == 162 and got.where("quantity < 0 and month(order_date) <> 3").isEmpty()
    assert got.select(F.when(F.col("quantity") < 0, -F.col("quantity") - 1).otherwise(F.col("quantity")).alias("q")).distinct().count() == 40_000
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in p or "Exchange rebalance" in p or "Rebalance" in p for p in plans)


def test_feed_inserts_the_key_of_a_copy(spark, scratch):
    """A returned line's copy wins over an inserted row with its key."""
    key = hashlib.sha256(b"L1|RET").hexdigest()
    store = OrderStore(spark, scratch, buckets=3)
    store.load(orders(spark, [("L1", "O1", datetime(2024, 1, 1).date(), 3, None)]))
    feed = orders(spark, [(key, "odd", datetime(2024, 2, 1).date(), 9, None)]).withColumn("op", F.lit("insert"))
    feed = feed.unionByName(orders(spark, [("L1", None, None, None, None)]).withColumn("op", F.lit("return")))
    for _ in range(2):
        apply_order_changes(store, feed)
        assert sorted((r["order_id"], r["quantity"]) for r in store.read().collect()) == [("O1", 3), ("O1-RET", -3)]


def test_replaced_lines_are_joined_once(spark):
    """The change set and the load of A04 read one table of lines."""
    from coldlake.plans import registry_store
    from coldlake.plans.catalog import Catalog
    built = []

    class Counting(Catalog):
        def table(self, name):
            built.append(name)
            return super().table(name)

    assert registry_store.QUERIES["A04_replace_by_key"][0](Counting(spark, SF_SMALL)).count() > 0
    assert built == ["fact_order"]
