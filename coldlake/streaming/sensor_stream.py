"""Structured Streaming form of the sensor pipeline (H1-H7, H9).

The 20-second refresh loop becomes a streaming query whose ``foreachBatch`` runs the
same ``SensorBatch`` plan as a backfill and commits its outputs as one epoch, published
by one marker - so a batch is visible as a whole or not at all, a micro-batch replayed
after a failure overwrites what the failed one left, and no batch is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from coldlake.config import DEFAULT_RULES, Rules, RunClock
from coldlake.functions.periods import minute_label
from coldlake.operators.sensor_pipeline import SensorBatch, incidents_of
from coldlake.schemas import FACT_SENSOR_READING
from coldlake.sources import fixtures
from coldlake.sources.epochs import FOLD, EpochLog, EpochStore, FoldedTable, KeyedSink
from coldlake.sources.tables import TableStore

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def commit_sensor_batch(store: EpochStore, arrivals: DataFrame, epoch: int = 0, rules: Rules = DEFAULT_RULES, clock: RunClock = RunClock(),
                        run_time: Column | None = None, one_run: bool = False, after: Callable[[str], None] | None = None) -> bool:
    """B11 persistence: all six tables and the reports' partials as one epoch, published at once (H9).

    Readings and raw rows whose event_id an earlier epoch holds are left out (exact cross-batch
    dedupe, H2), incidents follow their readings, and every rejection is kept. ``one_run`` says
    that all arrivals are one run: their event_ids are unique after its own dedupe, else the
    first run's row is taken. A repeated epoch changes nothing (False is returned).
    """
    head = store.log.head()
    if epoch <= head:
        return False
    batch = SensorBatch(arrivals, rules, clock, run_time).persist_labelled()
    raw, scored = batch.labelled.filter("keep_raw"), batch.scored
    if not one_run:
        raw, scored = _first_run(raw), _first_run(scored)
    if head >= 0:
        raw = raw.join(store.read("raw_sensor_events", head).select("event_id"), "event_id", "left_anti")
        scored = scored.join(store.read("fact_sensor_reading", head).select("event_id"), "event_id", "left_anti")
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return store.commit(epoch, {"raw_sensor_events": raw, "fact_sensor_reading": scored, "fact_incident": incidents_of(scored, rules),
                                    "rejected_events": batch.rejects, "data_quality_results": batch.quality, "pipeline_runs": batch.runs}, after)
    finally:
        scored.unpersist()
        batch.unpersist()


def _first_run(rows: DataFrame) -> DataFrame:
    """One row per event_id: the first run's (a run has one at most). Partial aggregation collapses a hot id."""
    least = rows.groupBy("event_id").agg(F.min("batch_id").alias("batch_id"))
    return rows.join(least, ["event_id", "batch_id"], "left_semi")


def event_stream(spark: SparkSession, events_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of the raw events table, a file or a folder of parts, with its declared
    schema. A path without any row fails now instead of streaming nothing for ever."""
    if spark.read.schema(EVENTS_SCHEMA).parquet(events_path).isEmpty():
        raise FileNotFoundError(f"no events under {events_path}")
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(events_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        # a stream reads folders: the table that is one file is that file of its folder
        return r.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return r.parquet(events_path)


def start_sensor_pipeline(spark: SparkSession, events_path: str, store: EpochStore, checkpoint: str,
                          rules: Rules = DEFAULT_RULES, clock: RunClock = RunClock(), max_files_per_trigger: int | None = None,
                          processing_time: str | None = "20 seconds", available_now: bool = False, backfill_clock: bool = False) -> StreamingQuery:
    """H1: events -> fixture arrivals -> foreachBatch(commit_sensor_batch).

    A micro-batch is one run: its epoch is the ``batch_id``, so a run is never split over two
    commits, and its trigger time is the run time (``backfill_clock``: the deterministic clock's).
    A replayed epoch is published already and changes nothing.
    """
    arrivals = fixtures.arrivals_from_events(event_stream(spark, events_path, max_files_per_trigger), clock)

    def run_batch(df: DataFrame, epoch_id: int) -> None:   # accepts empty micro-batches
        if df.isEmpty():
            return
        started = None if backfill_clock else F.lit(datetime.now(timezone.utc)).cast("timestamp")
        commit_sensor_batch(store, df.withColumn("batch_id", F.lit(epoch_id).cast("long")), epoch_id, rules, clock, started, one_run=True)

    w = arrivals.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def start_exact_dedupe(arrivals: DataFrame, store: TableStore, checkpoint: str) -> StreamingQuery:
    """H2: every event_id is stored once, whatever the batch or the age it comes back at.

    Each micro-batch keeps its first arrival of a key and anti-joins the stored keys, so
    nothing is dropped by lateness."""
    w = arrivals.writeStream.foreachBatch(lambda df, _: store.insert_if_absent("raw_sensor_events", df, "arrival_seq"))
    return w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_within_watermark(arrivals: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """H2 with bounded state, opt-in: repeats within the delay go, and so do rows later than it
    (``LateRows`` counts those). A repeat that comes when its id is forgotten is a new row."""
    return arrivals.withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def start_bounded_dedupe(arrivals: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """H2 bounded, into a parquet folder; the file sink's own log makes a replayed epoch harmless."""
    w = dedupe_within_watermark(arrivals, delay).writeStream.format("parquet").option("path", path)
    return w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MINUTE_COUNTS = T.StructType([T.StructField("minute", T.StringType()), T.StructField("temperature_status", T.StringType()), T.StructField("count", T.LongType())])


def minute_status_counts(readings: DataFrame, watermark: str | None = None) -> DataFrame:
    """H3/H4: readings per (1-minute window, status); with a watermark, late rows are dropped."""
    src = readings.withWatermark("event_timestamp", watermark) if watermark else readings
    return (src.groupBy(F.window("event_timestamp", "1 minute").alias("w"), "temperature_status")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(minute_label(F.col("w.start")).alias("minute"), "temperature_status", "count"))


def minute_counts_sink(spark: SparkSession, root: str) -> KeyedSink:
    return KeyedSink(spark, root, MINUTE_COUNTS, ["minute", "temperature_status"])


def start_minute_counts(readings: DataFrame, sink: KeyedSink, checkpoint: str, watermark: str | None = None) -> StreamingQuery:
    """H3 in update mode: a trigger hands the sink only the windows that it changed.

    The readings that arrive are counted by an observed metric ``arrived``; with a watermark,
    arrived less the counts in the sink is what was too late (H4).
    """
    counts = minute_status_counts(readings.observe("arrived", F.count(F.lit(1)).alias("n")), watermark)
    return _start(counts.writeStream.outputMode("update").foreachBatch(lambda df, epoch: sink.put(df, epoch) and None), checkpoint)


def start_closed_minutes(readings: DataFrame, path: str, checkpoint: str, watermark: str) -> StreamingQuery:
    """H4 in append mode: a window is written once, when the watermark has passed it, and its state is dropped."""
    return _start(minute_status_counts(readings, watermark).writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)


def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived_rows(query: StreamingQuery) -> int:
    """Rows of the observed metric ``arrived`` over the query's kept progress (the last 100 triggers by default)."""
    return sum(p["observedMetrics"]["arrived"]["n"] for p in query.recentProgress if "arrived" in (p["observedMetrics"] or {}))


def latest_position(readings: DataFrame) -> DataFrame:
    """H6: latest reading per vehicle as streaming state (update/complete output mode)."""
    return readings.groupBy("vehicle_id").agg(F.max_by(
        F.struct("latitude", "longitude", "temperature_c", "risk_level", "event_timestamp"),
        F.struct("event_timestamp", "event_id")).alias("r")).select(
        "vehicle_id", "r.latitude", "r.longitude", "r.temperature_c", "r.risk_level", "r.event_timestamp")


def latest_position_sink(spark: SparkSession, root: str) -> KeyedSink:
    fields = {f.name: f for f in FACT_SENSOR_READING.fields}
    names = ("vehicle_id", "latitude", "longitude", "temperature_c", "risk_level", "event_timestamp")
    return KeyedSink(spark, root, T.StructType([fields[n] for n in names]), ["vehicle_id"])


def start_latest_position(readings: DataFrame, sink: KeyedSink, checkpoint: str) -> StreamingQuery:
    """H6: the latest reading per vehicle is Spark's state; the sink gets the vehicles that reported."""
    return _start(latest_position(readings).writeStream.outputMode("update").foreachBatch(lambda df, epoch: sink.put(df, epoch) and None), checkpoint)


def freshness_state(readings: DataFrame) -> DataFrame:
    """H5: running maximum event time (complete mode); freshness = now - latest."""
    return readings.agg(F.max("event_timestamp").alias("latest_event_timestamp"))


class TrailingMinute:
    """H5: newest event time and the readings of the minute before it, after every trigger.

    The state is one row per second, merged over epochs and cut to the last ``span`` seconds up
    to the newest, so it holds that many rows however long the stream runs. Every trigger
    appends one row (epoch, latest_event_timestamp, readings, avg_risk) to the log of triggers.
    """

    def __init__(self, spark: SparkSession, root: str, span: int = 60, fold: int = FOLD):
        self.log = EpochLog(spark, root)
        self.span = span
        seconds = "second timestamp, n long, risk_sum double, latest timestamp"
        triggers = "at_epoch long, latest_event_timestamp timestamp, readings long, avg_risk double"
        self.seconds = FoldedTable(spark, f"{root.rstrip('/')}/seconds", T._parse_datatype_string(seconds), self._cut, fold)
        self.triggers = FoldedTable(spark, f"{root.rstrip('/')}/triggers", T._parse_datatype_string(triggers), lambda df: df, fold)

    def _cut(self, rows: DataFrame) -> DataFrame:
        since = rows.agg(F.max("second").alias("newest")).select(F.col("newest") - F.expr(f"INTERVAL {self.span} SECONDS")).scalar()
        recent = rows.where(F.col("second") > since)
        return recent.groupBy("second").agg(F.sum("n").alias("n"), F.sum("risk_sum").alias("risk_sum"), F.max("latest").alias("latest"))

    def put(self, readings: DataFrame, epoch: int) -> bool:
        head = self.log.head()
        if epoch <= head:
            return False
        new = self._cut(readings.select(F.date_trunc("second", "event_timestamp").alias("second"), F.lit(1).cast("long").alias("n"),
                                        F.col("risk_score").alias("risk_sum"), F.col("event_timestamp").alias("latest")))
        self.seconds.write(epoch, new, head)
        # the epoch's own rows are complete, though not published: the trigger's row sees them
        now = self.seconds.read(epoch).agg(F.lit(epoch).cast("long").alias("at_epoch"), F.max("latest").alias("latest_event_timestamp"),
                                           F.coalesce(F.sum("n"), F.lit(0)).alias("readings"), F.try_divide(F.sum("risk_sum"), F.sum("n")).alias("avg_risk"))
        self.triggers.write(epoch, now, head)
        self.log.publish(epoch)
        self.seconds.prune()
        self.triggers.prune()
        return True

    def history(self) -> DataFrame:
        """One row per trigger."""
        return self.triggers.read(self.log.head())


def start_trailing_minute(readings: DataFrame, state: TrailingMinute, checkpoint: str) -> StreamingQuery:
    return _start(readings.writeStream.foreachBatch(lambda df, epoch: state.put(df, epoch) and None), checkpoint)


class LateRows(StreamingQueryListener):
    """H4: rows that watermarks dropped, by query id, over the whole life of the queries.

    Spark counts them in its stateful operators and reports each trigger once; a query's own
    progress history is bounded, this sum is not. Register with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = defaultdict(int)

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.id)] += 0

    def onQueryProgress(self, event) -> None:
        for op in event.progress.stateOperators:
            self.dropped[str(event.progress.id)] += op.numRowsDroppedByWatermark or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
