"""Sensor batch pipeline (B1-B12): dedupe, validate, score, incidents, run metrics.

The input is a DataFrame of raw arrivals with the RAW_SENSOR_EVENTS columns plus
``batch_id`` (the run receiving the row) and ``arrival_seq`` (order of arrival
inside the run). A backfill processes many runs in one plan; a streaming
micro-batch is a frame with a single ``batch_id`` (see ``streaming.sensor_stream``).
Every output is a lazy DataFrame; ``SensorBatch.persist_labelled`` keeps the one
shared intermediate when several outputs are written from the same batch.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_RULES, DQ_CHECKS, Rules, RunClock
from coldlake.functions import sensor as fx
from coldlake.schemas import FACT_INCIDENT, FACT_SENSOR_READING, RAW_SENSOR_EVENTS, REJECTED_EVENTS
from coldlake.sources.fixtures import run_start

RAW_COLS = [f.name for f in RAW_SENSOR_EVENTS.fields]
FACT_COLS = [f.name for f in FACT_SENSOR_READING.fields]


#: A hot event_id is dealt over this many groups before its first arrival is known.
ARRIVAL_SPLITS = 32


def _arrival_groups(arrivals: DataFrame, splits: int) -> DataFrame:
    """Adds the total arrival order and ``_meet``: -1 for the firsts of an input split's group
    of one key, which meet under the key; any other arrival stays on its own."""
    order = F.struct("arrival_seq", F.xxhash64(*RAW_COLS).alias("content"), F.monotonically_increasing_id().alias("position"))
    rows = arrivals.withColumns({"_order": order, "_split": F.pmod(F.spark_partition_id(), F.lit(splits))})
    group = Window.partitionBy("batch_id", "event_id", "_split")
    rows = rows.withColumns({"_first": F.min("_order").over(group), "_first_dated": F.min(_dated_order()).over(group)})
    leads = (F.col("_order") == F.col("_first")) | F.coalesce(F.col("_order") == F.col("_first_dated"), F.lit(False))
    return rows.withColumn("_meet", F.when(leads, F.lit(-1)).otherwise(F.col("_order.position")))


def _dated_order() -> Column:
    return F.when(F.col("event_timestamp").isNotNull(), F.col("_order"))


def mark_duplicates(arrivals: DataFrame, splits: int = ARRIVAL_SPLITS) -> DataFrame:
    """B1: ``is_duplicate`` = not the first arrival of its event_id in its run.

    Arrivals are totally ordered by arrival_seq, then content, then reading position, so of
    equal rows exactly one is first; rows without an event_id share one key, as any other.
    One pass over the source: the first of every (run, event_id, input split) group is found,
    then only those firsts, at most two a group, meet under the bare key. A hot event_id is so
    dealt over ``splits`` groups and its other arrivals over all tasks. ``keep_raw`` marks the
    first arrival with an event_id and a timestamp (A3 / B12).
    """
    rows = _arrival_groups(arrivals, splits)
    key = Window.partitionBy("batch_id", "event_id", "_meet")
    met = F.col("_meet") == -1
    first = met & (F.col("_order") == F.min("_order").over(key))
    first_dated = met & F.coalesce(F.col("_order") == F.min(_dated_order()).over(key), F.lit(False))
    return (rows.withColumns({"is_duplicate": ~first, "keep_raw": first_dated & F.col("event_id").isNotNull()})
            .drop("_order", "_split", "_first", "_first_dated", "_meet"))


def label(arrivals: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """B1 + B2: add ``rejection_reason`` (NULL = valid). Duplicates are checked before validation."""
    return mark_duplicates(arrivals).withColumn(
        "rejection_reason",
        F.when(F.col("is_duplicate"), F.lit("duplicate_event_id")).otherwise(fx.rejection_reason(rules)))


def score(valid: DataFrame, rules: Rules = DEFAULT_RULES, ranges: dict | None = None) -> DataFrame:
    """B4-B6 on validated rows: temperature status, risk score, risk level, anomaly flag."""
    return (valid
            .withColumn("temperature_status", fx.temperature_status(rules=rules, ranges=ranges))
            .withColumn("risk_score", fx.risk_score(rules=rules))
            .withColumns({"risk_level": fx.risk_level(rules=rules), "anomaly_flag": fx.anomaly_flag()}))


def incidents_of(scored: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """B7 + B8: 0..4 incidents per scored reading, keyed by (event_id, incident_type)."""
    exploded = scored.select("event_id", "shipment_id", "vehicle_id", "event_timestamp",
                             F.explode(fx.incident_structs(rules)).alias("i"))
    return exploded.select(
        fx.row_key("event_id", F.col("i.incident_type")).alias("incident_id"),
        "event_id", "shipment_id", "vehicle_id",
        F.col("i.incident_type").alias("incident_type"),
        F.col("i.severity").alias("severity"),
        F.col("event_timestamp").alias("incident_timestamp"),
        F.col("i.description").alias("description"),
    )


def raw_payload() -> Column:
    """The whole raw event as JSON, nulls included."""
    return F.to_json(F.struct(*[F.col(c) for c in RAW_COLS]), {"ignoreNullFields": "false"})


class SensorBatch:
    """All outputs of B11 ``run_pipeline`` for the runs contained in ``arrivals``."""

    def __init__(self, arrivals: DataFrame, rules: Rules = DEFAULT_RULES, clock: RunClock = RunClock(),
                 run_time: Column | None = None):
        self.arrivals = arrivals
        self.rules = rules
        self.clock = clock
        # processing time of a run; the backfill clock unless a trigger time is given
        self._run_time = run_time

    def run_time(self) -> Column:
        return self._run_time if self._run_time is not None else run_start(F.col("batch_id"), self.clock)

    @cached_property
    def labelled(self) -> DataFrame:
        return label(self.arrivals, self.rules)

    def persist_labelled(self) -> "SensorBatch":
        """Keep the labelled batch (it feeds every output) and the per-run counters (runs and quality)."""
        self.labelled.persist(StorageLevel.MEMORY_AND_DISK)
        self.batch_stats.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.batch_stats.unpersist()
        self.labelled.unpersist()

    @cached_property
    def scored(self) -> DataFrame:
        valid = self.labelled.filter(F.col("rejection_reason").isNull())
        return score(valid, self.rules).withColumn("processed_at", self.run_time())

    @property
    def fact(self) -> DataFrame:
        """fact_sensor_reading rows of these runs."""
        return self.scored.select(*FACT_COLS)

    @property
    def incidents(self) -> DataFrame:
        return incidents_of(self.scored, self.rules).select(*[f.name for f in FACT_INCIDENT.fields])

    @property
    def rejects(self) -> DataFrame:
        """B3 rejected_events rows (one per rejected arrival, duplicates included).

        Equal arrivals get different keys: they are numbered inside the partition group that
        they lie in, so that no group of copies, however large, meets in one task."""
        rej = self.labelled.filter(F.col("rejection_reason").isNotNull()).withColumns(
            {"_content": F.xxhash64(*RAW_COLS), "_group": F.pmod(F.spark_partition_id(), F.lit(ARRIVAL_SPLITS))})
        nth = F.row_number().over(Window.partitionBy("batch_id", "event_id", "arrival_seq", "_content", "_group").orderBy(F.lit(0)))
        return rej.withColumn("_nth", nth).select(
            fx.row_key("batch_id", "event_id", "arrival_seq", "_content", "_group", "_nth").alias("rejection_id"),
            "event_id", "rejection_reason", raw_payload().alias("raw_payload"),
            self.run_time().alias("rejected_at"),
        ).select(*[f.name for f in REJECTED_EVENTS.fields])

    @property
    def raw(self) -> DataFrame:
        """A3 + B12: the raw rows a keyed, NOT NULL insert keeps: first arrival per event_id
        among rows with a non-null key and timestamp."""
        return self.labelled.filter(F.col("keep_raw")).select(*RAW_COLS)

    @cached_property
    def batch_stats(self) -> DataFrame:
        """One row per run: all B9/B10 counters from a single aggregate (no joins)."""
        reason = F.col("rejection_reason")
        valid = reason.isNull()
        aggs = [
            F.count(F.lit(1)).alias("rows_generated"),
            F.count_if(valid).alias("rows_processed"),
            F.count_if(~valid).alias("rows_rejected"),
            F.sum(F.when(valid, fx.incident_count(self.rules)).otherwise(F.lit(0))).cast("long")
            .alias("incidents_created"),
        ] + [F.count_if(reason == F.lit(c)).alias(f"_fail_{c}") for c in DQ_CHECKS]
        # scoring columns are only read for valid rows (the incident count)
        return score(self.labelled, self.rules).groupBy("batch_id").agg(*aggs)

    @property
    def runs(self) -> DataFrame:
        """B9 pipeline_runs rows."""
        t = self.run_time()
        return self.batch_stats.select(
            fx.row_key(F.lit("run"), "batch_id").alias("run_id"),
            t.alias("started_at"), t.alias("finished_at"),
            "rows_generated", "rows_processed", "rows_rejected", "incidents_created",
            F.lit("SUCCESS").alias("status"),
        )

    @property
    def quality(self) -> DataFrame:
        """B10 data_quality_results: nine zero-filled checks per run."""
        checks = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(f"_fail_{c}").cast("long").alias("failures"))
                           for c in DQ_CHECKS])
        run_id = fx.row_key(F.lit("run"), "batch_id")
        per = self.batch_stats.select(run_id.alias("run_id"), self.run_time().alias("created_at"),
                                      F.greatest(F.col("rows_generated"), F.lit(1)).cast("long")
                                      .alias("records_checked"),
                                      F.explode(checks).alias("c"))
        return per.select(
            fx.row_key("run_id", F.col("c.check_name")).alias("quality_id"),
            "run_id", F.col("c.check_name").alias("check_name"), "records_checked",
            F.col("c.failures").alias("failures"),
            F.when(F.col("c.failures") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
            "created_at",
        )

    def report(self) -> DataFrame:
        """B11 return value per run: run_id and the four counters."""
        return self.runs.select("run_id", "rows_generated", "rows_processed", "rows_rejected", "incidents_created")
