"""Mergeable partial aggregates of the operations reports, one small table per grain.

``partial`` aggregates the rows of one epoch, ``merged`` brings the partials of any epochs
together: sums add up, greatest and least values stay. Reports that read them cost the number
of cells, not of readings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_RULES, Rules
from coldlake.operators import ops_reports as R


@dataclass(frozen=True)
class Grain:
    """Keys and measures over the rows of ``source``, as expressions on its columns."""

    source: str
    keys: dict[str, Column]
    sums: dict[str, Column] = field(default_factory=dict)
    greatest: dict[str, Column] = field(default_factory=dict)
    least: dict[str, Column] = field(default_factory=dict)
    #: columns without which a row doesn't count
    needs: tuple[str, ...] = ()


def _one(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def grains(rules: Rules = DEFAULT_RULES) -> dict[str, Grain]:
    """The grains that the reports below read."""
    one = F.lit(1).cast("long")
    shift = R.correlation_shift(rules)
    c = {x: F.col(x).cast("double") - F.lit(shift[x]) for x in R.CORR_COLUMNS}
    return {
        "cell": Grain("fact_sensor_reading", {k: F.col(k) for k in ("shipment_id", "vehicle_id", "temperature_status", "risk_level")}, {
            "n": one, "risk_sum": F.col("risk_score"), "battery_sum": F.col("battery_pct"), "humidity_sum": F.col("humidity_pct"),
            "temperature_sum": F.col("temperature_c"), "closed_n": _one(F.col("door_open") == 0), "anomaly_n": F.col("anomaly_flag").cast("long"),
            "low_battery_n": _one(F.col("battery_pct") < 30)}),
        "minute": Grain("fact_sensor_reading", {"minute_start": F.date_trunc("minute", "event_timestamp"), "temperature_status": F.col("temperature_status")},
                        {"n": one, "door_opens": F.col("door_open").cast("long")}),
        "latest": Grain("fact_sensor_reading", {"vehicle_id": F.col("vehicle_id")}, greatest={"r": F.struct(
            "event_timestamp", "event_id", "latitude", "longitude", "temperature_c", "risk_level")}),
        "moments": Grain("fact_sensor_reading", {"all": F.lit(0)},
                         {"n": one} | {f"s_{a}": c[a] for a in c} | {f"p_{a}__{b}": c[a] * c[b] for i, a in enumerate(R.CORR_COLUMNS) for b in R.CORR_COLUMNS[i:]},
                         {f"hi_{a}": c[a] for a in c}, {f"lo_{a}": c[a] for a in c}, tuple(R.CORR_COLUMNS)),
        "incident": Grain("fact_incident", {k: F.col(k) for k in ("incident_type", "severity")}, {"n": one}),
        "reject": Grain("rejected_events", {"rejection_reason": F.col("rejection_reason")}, {"n": one}),
        "run": Grain("pipeline_runs", {"all": F.lit(0)}, {"n": one} | {k: F.col(k) for k in ("rows_generated", "rows_processed", "rows_rejected")},
                     {"latest": F.struct("started_at", "run_id", "status", "finished_at")}),
        "check": Grain("data_quality_results", {"check_name": F.col("check_name")}, {k: F.col(k) for k in ("records_checked", "failures")},
                       {"latest": F.struct(F.col("created_at"), F.col("run_id"), F.col("records_checked"), F.col("failures"))}),
    }


def partial(rows: DataFrame, g: Grain) -> DataFrame:
    """One epoch's rows at the grain."""
    rows = rows.na.drop(subset=list(g.needs)) if g.needs else rows
    return rows.groupBy(*[e.alias(k) for k, e in g.keys.items()]).agg(
        *[F.sum(e).alias(k) for k, e in g.sums.items()], *[F.max(e).alias(k) for k, e in g.greatest.items()], *[F.min(e).alias(k) for k, e in g.least.items()])


def merged(rows: DataFrame, g: Grain) -> DataFrame:
    """Partials of several epochs as one; merging what is merged changes nothing."""
    return rows.groupBy(*g.keys).agg(*[F.sum(k).alias(k) for k in g.sums], *[F.max(k).alias(k) for k in g.greatest], *[F.min(k).alias(k) for k in g.least])
