"""Registered queries of the refresh loop: a stream over several files, its epochs, partials and live states.

The events, or the readings of their pipeline, are written as a few files one after another,
so that every stream here runs several micro-batches in a known order; all rows take part.
One stream per catalog feeds the reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake import oracle_sql as O
from coldlake.operators.live_reports import LiveReports
from coldlake.plans import registry_ops as ops
from coldlake.plans.catalog import Catalog
from coldlake.plans.registry_store import folder
from coldlake.sources.epochs import EpochStore, Folder
from coldlake.streaming import sensor_stream as S

QUERIES: dict[str, tuple] = {}
FILES = 5
#: A snapshot every second epoch, so that the few epochs here are merged more than once.
FOLD = 2


def q(name: str, sql: str):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


#: Rows of a file: a number's rows are dealt over several files, so that no single task writes or reads them all.
ROWS_A_FILE = 10_000


def written(rows: DataFrame, number: Column, files: int, path: str, rows_a_file: int | None = None) -> tuple[str, int]:
    """``rows`` written by their ``number``, one number after another, each as the same count of files; the
    path and that count, which as ``maxFilesPerTrigger`` makes every number one micro-batch.

    A number has a file per ``rows_a_file`` rows on average, at most one per core. One of too few
    rows for all of its files is filled up with files without rows.
    """
    spark = rows.sparkSession
    parts = max(1, min(spark.sparkContext.defaultParallelism, rows.count() // (files * (rows_a_file or ROWS_A_FILE))))
    target, empty = Folder(spark, path), spark.createDataFrame([], rows.schema).coalesce(1)
    for k in range(files):
        own = rows.where(number == k)
        (own.repartition(parts) if parts > 1 else own.coalesce(1)).write.mode("append").parquet(path)
        for _ in range(parts * (k + 1) - sum(name.startswith("part-") for name in target.names())):
            empty.write.mode("append").parquet(path)
    return path, parts


def _events_by_id(c: Catalog) -> tuple[str, int]:
    """The events in order of their ids, FILES times a number of files."""
    events = c.spark.read.parquet(f"{c.sf_dir}/events.parquet")
    lo = events.agg(F.min("event_id")).scalar()
    hi = events.agg(F.max("event_id")).scalar()
    return written(events, F.floor((F.col("event_id") - lo) * FILES / (hi - lo + 1)), FILES, f"{folder(c, 'events-by-id')}/events")


def live_store(c: Catalog) -> EpochStore:
    """The store that a stream over the files has filled: one epoch a file number, run once per catalog."""
    if "_live" not in c.__dict__:
        base = folder(c, "live")
        store = EpochStore(c.spark, f"{base}/tables", FOLD)
        path, parts = _events_by_id(c)
        S.start_sensor_pipeline(c.spark, path, store, f"{base}/checkpoint", c.rules, c.clock, max_files_per_trigger=parts,
                                available_now=True, backfill_clock=True).awaitTermination()
        c.__dict__["_live"] = store
    return c.__dict__["_live"]


def by_file(sql: str) -> str:
    """Oracle SQL in which a run is a file of ``_events_by_id`` instead of 500 events."""
    assert sql.count("event_id // 500") == 2
    return sql.replace("event_id // 500", f"((event_id - (SELECT min(event_id) FROM events)) * {FILES} // (SELECT max(event_id) - min(event_id) + 1 FROM events))")


# ------------------------------------------------------------------ H1: reports from partials after the stream

LIVE = {
    "C01_top_kpis": lambda r, c: r.top_kpis(), "C02_second_kpis": lambda r, c: r.second_kpis(), "C07a_compliance_distribution": lambda r, c: r.compliance_distribution(),
    "C07b_risk_distribution": lambda r, c: r.risk_distribution(), "C08_risk_by_warehouse": lambda r, c: r.risk_by_warehouse(c.dim_shipment),
    "C09_risk_by_food_category": lambda r, c: r.risk_by_food_category(c.dim_shipment), "C10_vehicle_health": lambda r, c: r.vehicle_health(),
    "C11_latest_vehicle_locations": lambda r, c: r.latest_vehicle_locations(), "C12_shipment_health": lambda r, c: r.shipment_health(),
    "C14_incident_severity_counts": lambda r, c: r.incident_severity_counts(), "C15_incident_type_counts": lambda r, c: r.incident_type_counts(),
    "C16_pipeline_health": lambda r, c: r.pipeline_health(), "C18a_data_quality_summary": lambda r, c: r.data_quality_summary(),
    "C18b_rejection_reasons": lambda r, c: r.rejection_reasons(), "C20_data_freshness_seconds": lambda r, c: r.data_freshness_seconds(F.to_timestamp(F.lit(ops.NOW))),
    "C22_anomaly_rate": lambda r, c: r.anomaly_rate(), "C26_status_over_time": lambda r, c: r.status_over_time(), "C27_door_open_trend": lambda r, c: r.door_open_trend(),
    "C28_hourly_reading_counts": lambda r, c: r.hourly_reading_counts(), "C32_food_category_compliance": lambda r, c: r.food_category_compliance(c.dim_shipment),
    "C34_correlation_matrix": lambda r, c: r.sensor_correlation_matrix(), "C35_system_health_score": lambda r, c: r.system_health_score(),
}
for _name, _report in LIVE.items():
    QUERIES[f"{_name}_live"] = (lambda c, report=_report: report(LiveReports(live_store(c)), c), by_file(ops.QUERIES[_name][1]))


@q("H01_stream_commit", O.sensor("""
SELECT event_id, temperature_status, risk_score, risk_level, shipment_id FROM fact"""))
def _h01(c: Catalog):
    return live_store(c).read("fact_sensor_reading").select("event_id", "temperature_status", "risk_score", "risk_level", "shipment_id")


@q("H01_stream_run_log", by_file(O.sensor("""
SELECT started_at, finished_at, rows_generated, rows_processed, rows_rejected, incidents_created, status FROM runs""")))
def _h01_log(c: Catalog):
    return live_store(c).read("pipeline_runs").drop("run_id")


@q("H01_partial_rows", by_file(O.sensor("""
, cells AS (SELECT DISTINCT shipment_id, vehicle_id, temperature_status, risk_level, batch_id FROM fact),
minutes AS (SELECT DISTINCT strftime(event_timestamp, '%Y-%m-%dT%H:%M') AS m, temperature_status, batch_id FROM fact)
SELECT 'cell' AS grain, (SELECT count(DISTINCT (shipment_id, vehicle_id, temperature_status, risk_level)) FROM cells WHERE batch_id < 4)
  + (SELECT count(*) FROM cells WHERE batch_id = 4) AS rows_read
UNION ALL SELECT 'minute', (SELECT count(DISTINCT (m, temperature_status)) FROM minutes WHERE batch_id < 4) + (SELECT count(*) FROM minutes WHERE batch_id = 4)""")))
def _h01_rows(c: Catalog):
    """What a report reads at the last head: the state's own rows and those of the epochs since its snapshot, not all epochs'."""
    store = live_store(c)
    out = None
    for name in ("cell", "minute"):
        one = store.folded[name].stored(store.log.head()).agg(F.lit(name).alias("grain"), F.count("*").alias("rows_read"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ H9: one epoch, all tables or none

SIX = ("raw_sensor_events", "fact_sensor_reading", "fact_incident", "rejected_events", "data_quality_results", "pipeline_runs")
SIX_SQL = {"raw_sensor_events": "raw", "fact_sensor_reading": "fact", "fact_incident": "incidents JOIN (SELECT event_id, batch_id FROM fact) USING (event_id)",
           "rejected_events": "rejects", "data_quality_results": "quality", "pipeline_runs": "runs"}


def _six(store: EpochStore, shown: str) -> DataFrame:
    out = None
    for name in SIX:
        one = store.count(name).select(F.lit(shown).alias("shown"), F.lit(name).alias("table_name"), F.col("rows").alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out


@q("H09_idempotent_commit", O.sensor("\nUNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {SIX_SQL[n]}) AS row_count" for n in SIX)))
def _h09(c: Catalog):
    """Row counts after the same epoch is committed twice."""
    store = EpochStore(c.spark, folder(c, "h09"))
    for _ in range(2):
        S.commit_sensor_batch(store, c.sensor_batch.arrivals, 0, c.rules, c.clock)
    return _six(store, "").drop("shown")


class Crash(Exception):
    """The commit dies between two tables."""


def _even(sql: str) -> str:
    return f"(SELECT count(*) FROM {sql} WHERE batch_id % 2 = 0)"


_OLD = {n: _even(SIX_SQL[n]) for n in SIX} | {
    "data_quality_results": "(SELECT 9 * count(DISTINCT batch_id) FROM labelled WHERE batch_id % 2 = 0)",
    "pipeline_runs": "(SELECT count(DISTINCT batch_id) FROM labelled WHERE batch_id % 2 = 0)"}


@q("H09_crash_between_tables", O.sensor("\nUNION ALL ".join(
    [f"SELECT 'after the crash' AS shown, '{n}' AS table_name, {_OLD[n]} AS row_count" for n in SIX]
    + [f"SELECT 'after the retry', '{n}', (SELECT count(*) FROM {SIX_SQL[n]})" for n in SIX])))
def _h09_crash(c: Catalog):
    """Even runs are an epoch; the odd runs' commit dies after its third table, then comes again."""
    store = EpochStore(c.spark, folder(c, "h09-crash"))
    arrivals = c.sensor_batch.arrivals
    S.commit_sensor_batch(store, arrivals.where("batch_id % 2 = 0"), 0, c.rules, c.clock)
    seen: list[str] = []

    def dies(name: str) -> None:
        seen.append(name)
        if len(seen) >= 3:
            raise Crash(name)

    odd = arrivals.where("batch_id % 2 = 1")
    try:
        S.commit_sensor_batch(store, odd, 1, c.rules, c.clock, after=dies)
    except Crash:
        pass
    head = store.log.head()
    before = None
    for name in SIX:                                   # a reader that took the head before the retry
        one = store.read(name, head).agg(F.lit("after the crash").alias("shown"), F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        before = one if before is None else before.unionByName(one)
    S.commit_sensor_batch(store, odd, 1, c.rules, c.clock)
    return before.unionByName(_six(store, "after the retry"))


@q("H09_every_rejection", O.sensor("""
SELECT rejection_reason, count(*) + CASE WHEN rejection_reason = 'duplicate_event_id' THEN (SELECT 2 * count(*) FROM arrivals WHERE shipment_id = 'SHIP-0011') ELSE 0 END AS stored,
  count(*) + CASE WHEN rejection_reason = 'duplicate_event_id' THEN (SELECT 2 * count(*) FROM arrivals WHERE shipment_id = 'SHIP-0011') ELSE 0 END AS keys
FROM rejects GROUP BY 1"""))
def _h09_rejections(c: Catalog):
    """All arrivals of one shipment come three times, equal in every column: each rejection is stored under a key of its own."""
    store = EpochStore(c.spark, folder(c, "h09-rejections"))
    arrivals = c.sensor_batch.arrivals
    again = arrivals.where("shipment_id = 'SHIP-0011'")
    S.commit_sensor_batch(store, arrivals.unionByName(again).unionByName(again), 0, c.rules, c.clock)
    return store.read("rejected_events").groupBy("rejection_reason").agg(F.count("*").alias("stored"), F.count_distinct("rejection_id").alias("keys"))


# ------------------------------------------------------------------ H2-H6: states

#: Files of readings that each span the whole time: event number modulo the files.
MIXED = 4


def _readings(c: Catalog) -> DataFrame:
    """The published readings as a stream of files out of time order."""
    if "_mixed" not in c.__dict__:
        fact = live_store(c).read("fact_sensor_reading")
        c.__dict__["_mixed"] = written(fact, F.substring("event_id", 2, 20).cast("long") % MIXED, MIXED, f"{folder(c, 'readings')}/fact"), fact.schema
    (path, parts), schema = c.__dict__["_mixed"]
    return c.spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(path)


@q("H02_dedupe_within_watermark", O.sensor("""
, t AS (SELECT min(epoch_us(event_timestamp)) AS lo, CAST(ceil((max(epoch_us(event_timestamp)) - min(epoch_us(event_timestamp)) + 1) / 4e6) AS BIGINT) AS w FROM raw)
SELECT event_id, event_timestamp FROM raw
UNION ALL SELECT event_id, event_timestamp + to_seconds(3 * w) FROM raw, t WHERE (epoch_us(event_timestamp) - lo) // (w * 1000000) = 0"""))
def _h02_bounded(c: Catalog):
    """Four files in time order, the delay a quarter of a file's span. The last one also repeats ids:
    of the first file, later than the delay (new rows); of the third, inside it (dropped); of the
    second, at their old time (too late, dropped)."""
    raw = live_store(c).read("raw_sensor_events").select("event_id", "event_timestamp")
    span = raw.agg(F.min(F.unix_micros("event_timestamp")).alias("lo"), F.max(F.unix_micros("event_timestamp")).alias("hi")).first()
    w = -(-(span["hi"] - span["lo"] + 1) // 4_000_000)
    number = F.floor((F.unix_micros("event_timestamp") - F.lit(span["lo"])) / F.lit(w * 1_000_000))
    later = lambda k: raw.where(number == k).withColumn("event_timestamp", F.col("event_timestamp") + F.expr(f"INTERVAL {(3 - k) * w} SECONDS"))
    rows = raw.withColumn("file", number)
    for repeat in (later(0), later(2), raw.where(number == 1)):
        rows = rows.unionByName(repeat.withColumn("file", F.lit(3).cast("long")))
    base = folder(c, "h02-bounded")
    src, parts = written(rows, F.col("file"), 4, f"{base}/arrivals")
    stream = c.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(src)
    S.start_bounded_dedupe(stream, f"{base}/kept", f"{base}/checkpoint", f"{max(1, w // 4)} seconds").awaitTermination()
    return c.spark.read.schema(rows.schema).parquet(f"{base}/kept").drop("file")


@q("H03_minute_status_counts", O.sensor("""
SELECT strftime(event_timestamp, '%Y-%m-%dT%H:%M') AS minute, temperature_status, count(*) AS count
FROM fact GROUP BY 1, 2"""))
def _h03(c: Catalog):
    """Update mode over files out of time order into a keyed sink; then an old epoch comes again with other rows."""
    base = folder(c, "h03")
    sink = S.minute_counts_sink(c.spark, f"{base}/counts")
    S.start_minute_counts(_readings(c), sink, f"{base}/checkpoint").awaitTermination()
    sink.put(sink.read().withColumn("count", F.lit(-1).cast("long")), 1)
    return sink.read()


#: Rows of file k are late when their minute has ended by the newest time of files up to k - 2, less the delay.
_LATE = f"""
, r AS (SELECT *, CAST(substr(event_id, 2) AS BIGINT) % {MIXED} AS file, date_trunc('minute', event_timestamp) AS start FROM fact),
newest AS (SELECT file, max(event_timestamp) AS t FROM r GROUP BY file),
judged AS (SELECT r.*, coalesce(start + INTERVAL 1 MINUTE <= (SELECT max(t) FROM newest n WHERE n.file <= r.file - 2) - INTERVAL 10 MINUTE, false) AS late FROM r)
"""


@q("H04_late_rows", O.sensor(_LATE + """
SELECT count(*) AS arrived, count(*) FILTER (WHERE NOT late) AS kept, count(*) FILTER (WHERE late) AS dropped FROM judged"""))
def _h04_late(c: Catalog):
    """Readings that arrived, that reached a window, and that came behind the watermark of ten minutes."""
    base = folder(c, "h04-late")
    sink = S.minute_counts_sink(c.spark, f"{base}/counts")
    query = S.start_minute_counts(_readings(c), sink, f"{base}/checkpoint", "10 minutes")
    query.awaitTermination()
    arrived = F.lit(S.arrived_rows(query)).cast("long")
    return sink.read().agg(arrived.alias("arrived"), F.sum("count").alias("kept"), (arrived - F.sum("count")).alias("dropped"))


@q("H04_closed_minutes", O.sensor(_LATE + """
SELECT strftime(start, '%Y-%m-%dT%H:%M') AS minute, temperature_status, count(*) AS count FROM judged
WHERE NOT late AND start + INTERVAL 1 MINUTE <= (SELECT max(t) FROM newest) - INTERVAL 10 MINUTE GROUP BY 1, 2"""))
def _h04_closed(c: Catalog):
    """Append mode: each minute is written once, when the watermark has passed its end."""
    base = folder(c, "h04-closed")
    S.start_closed_minutes(_readings(c), f"{base}/closed", f"{base}/checkpoint", "10 minutes").awaitTermination()
    return c.spark.read.schema(S.MINUTE_COUNTS).parquet(f"{base}/closed")


@q("H05_freshness_state", O.sensor(f"""
, r AS (SELECT *, CAST(substr(event_id, 2) AS BIGINT) % {MIXED} AS file, date_trunc('second', event_timestamp) AS s FROM fact),
k AS (SELECT file, (SELECT max(event_timestamp) FROM r b WHERE b.file <= a.file) AS latest FROM (SELECT DISTINCT file FROM r) a)
SELECT k.file AS at_epoch, k.latest AS latest_event_timestamp, count(*) AS readings, round_even(avg(r.risk_score), 6) AS avg_risk
FROM k JOIN r ON r.file <= k.file AND r.s > date_trunc('second', k.latest) - INTERVAL 60 SECOND GROUP BY 1, 2"""))
def _h05(c: Catalog):
    """Newest event time and the trailing minute after each of the triggers."""
    base = folder(c, "h05")
    state = S.TrailingMinute(c.spark, f"{base}/state", fold=FOLD)
    S.start_trailing_minute(_readings(c), state, f"{base}/checkpoint").awaitTermination()
    return state.history().withColumn("avg_risk", F.bround("avg_risk", 6))


@q("H06_latest_position", O.sensor("""
SELECT vehicle_id, latitude, longitude, temperature_c, risk_level, event_timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM fact)
WHERE rn = 1"""))
def _h06(c: Catalog):
    """Update mode over files out of time order: the sink gets the vehicles of each file."""
    base = folder(c, "h06")
    sink = S.latest_position_sink(c.spark, f"{base}/positions")
    S.start_latest_position(_readings(c), sink, f"{base}/checkpoint").awaitTermination()
    return sink.read()
