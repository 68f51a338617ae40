"""Values the operations view derives from the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_RULES, RISK_LEVELS, TEMPERATURE_STATUSES, Rules
from coldlake.functions.numeric import half_even, pct
from coldlake.functions.periods import minute_label
from coldlake.operators import ops_reports as R
from coldlake.operators.common import attach_scalars, stat

DISPLAY_TZ = "Asia/Kolkata"   # UTC+05:30, display only


def checks_passed(quality: DataFrame) -> DataFrame:
    """Passing checks / checks in the summary."""
    return R.data_quality_summary(quality).agg(
        F.count_if(F.col("status") == "PASS").alias("checks_passed"), F.count(F.lit(1)).alias("checks_total"))


def total_rejections(rejects: DataFrame) -> DataFrame:
    """D2."""
    return rejects.agg(F.count(F.lit(1)).alias("total_rejections"))


def _first_of(report: DataFrame, metric: str, name: str, alias: str, default: str) -> DataFrame:
    """Name on the first row of a report sorted by metric desc, name asc."""
    return report.agg(F.coalesce(F.min_by(F.col(name), F.struct(-F.col(metric), F.col(name))), F.lit(default))
                      .alias(alias))


def leaders(fact: DataFrame, incidents: DataFrame, raw: DataFrame) -> DataFrame:
    """D3: top incident type, highest-risk (event) warehouse, riskiest vehicle."""
    top_type = _first_of(R.incident_type_counts(incidents), "count", "incident_type", "top_incident_type", "None")
    risk = F.avg("risk_score").alias("avg_risk")          # unrounded: rounding must not make ties
    wh = _first_of(R.with_event_warehouse(fact, raw).groupBy("warehouse").agg(risk), "avg_risk", "warehouse", "riskiest_warehouse", "N/A")
    veh = _first_of(fact.groupBy("vehicle_id").agg(risk), "avg_risk", "vehicle_id", "riskiest_vehicle", "N/A")
    return attach_scalars(top_type, wh, veh)


def in_transit_count(raw: DataFrame) -> DataFrame:
    """Raw readings (not shipments) whose delivery status is IN_TRANSIT."""
    return raw.agg(F.count_if(F.col("delivery_status") == "IN_TRANSIT").alias("in_transit"))


def fleet_avg_battery(fact: DataFrame) -> DataFrame:
    """Unweighted mean of per-vehicle mean battery, 1 dp."""
    per = fact.groupBy("vehicle_id").agg(F.avg("battery_pct").alias("b"))
    return per.agg(F.coalesce(half_even(F.avg("b"), 1), F.lit(0.0)).alias("fleet_avg_battery"))


def shipment_health_summary(fact: DataFrame, incidents: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Healthy / at-risk shipments, mean health (1 dp), total incidents."""
    h = R.shipment_health(fact, rules).agg(
        F.count_if(F.col("status") == "HEALTHY").alias("healthy_shipments"),
        F.count_if(F.col("status") == "AT RISK").alias("at_risk_shipments"),
        F.coalesce(half_even(F.avg("health_score"), 1), F.lit(0.0)).alias("avg_health_score"))
    return attach_scalars(h, incidents.agg(F.count(F.lit(1)).alias("total_incidents")))


def safe_share(fact: DataFrame) -> DataFrame:
    """D7 (donut centre): SAFE share of readings, 1 dp."""
    dist = R.compliance_distribution(fact)
    return dist.agg(F.coalesce(half_even(pct(F.sum(F.when(F.col("status") == "SAFE", F.col("count"))),
                                             F.sum("count")), 1), F.lit(0.0)).alias("safe_pct"))


def _position(values: list[str], c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), c)


def risk_levels_ordered(fact: DataFrame) -> DataFrame:
    """C7b in categorical order LOW < MEDIUM < HIGH < CRITICAL."""
    return R.risk_distribution(fact).orderBy(_position(RISK_LEVELS, F.col("risk_level")))


def flow_edges(fact: DataFrame, raw: DataFrame, dim_shipment: DataFrame) -> DataFrame:
    """Warehouse -> category and category -> risk level edges, weight = readings."""
    flow = R.warehouse_food_risk_flow(fact, raw, dim_shipment)
    a = flow.groupBy(F.col("warehouse").alias("source"), F.col("food_category").alias("target")).agg(
        F.sum("count").cast("long").alias("value"))
    b = flow.groupBy(F.col("food_category").alias("source"), F.col("risk_level").alias("target")).agg(
        F.sum("count").cast("long").alias("value"))
    return a.withColumn("stage", F.lit(1)).unionByName(b.withColumn("stage", F.lit(2)))


def fleet_radar(fact: DataFrame) -> DataFrame:
    """Unweighted means over shipments, long form (axis, value)."""
    sh = R.shipment_health(fact)
    wide = sh.agg(F.avg("temp_compliance").alias("a"), (F.lit(100.0) - F.avg("avg_risk")).alias("b"),
                  F.avg("avg_battery").alias("c"), F.avg("door_discipline").alias("d"))
    axes = [("Temp Compliance", "a"), ("Risk Safety", "b"), ("Battery", "c"), ("Door Discipline", "d")]
    arr = F.array(*[F.struct(F.lit(n).alias("axis"), stat(F.col(c)).alias("value")) for n, c in axes])
    return wide.select(F.explode(arr).alias("r")).select("r.axis", "r.value")


def status_pivot(fact: DataFrame) -> DataFrame:
    """Minute x status counts, zero-filled, fixed column order (explicit pivot values: no eager job)."""
    return (fact.groupBy(minute_label("event_timestamp").alias("minute"))
            .pivot("temperature_status", TEMPERATURE_STATUSES).agg(F.count(F.lit(1)))
            .na.fill(0, TEMPERATURE_STATUSES).orderBy("minute"))


def throughput_indexed(runs: DataFrame, limit: int = 25) -> DataFrame:
    """C30 with run_index 1..n (window over the <= limit rows left after the top-k)."""
    from pyspark.sql import Window as W
    tp = R.pipeline_throughput(runs, limit)
    return tp.withColumn("run_index", F.row_number().over(W.orderBy("started_at")))


def worst_shipments(fact: DataFrame, limit: int = 15) -> DataFrame:
    """Lowest health scores."""
    sh = R.shipment_health_exact(fact)
    return sh.orderBy("health_score", "shipment_id").limit(limit).select(
        "shipment_id", "health_score", half_even("avg_risk", 1).alias("avg_risk"),
        half_even("temp_compliance", 1).alias("temp_compliance"), "status")


def freshness_label(c: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return (F.when(c < rules.fresh_below_s, F.lit("HEALTHY")).when(c < rules.stale_from_s, F.lit("WARNING"))
            .otherwise(F.lit("CRITICAL")))


def health_band(c: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return F.when(c >= rules.health_healthy, F.lit("SAFE")).when(c >= rules.health_watch, F.lit("WARNING")) \
        .otherwise(F.lit("CRITICAL"))


def status_labels(fact: DataFrame, runs: DataFrame, quality: DataFrame, now: Column,
                  rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Freshness label (NULL when there is no reading) and system-health band."""
    fresh = R.data_freshness_seconds(fact, now)
    out = attach_scalars(fresh, R.system_health_score(fact, runs, quality))
    return out.select("freshness_seconds",
                      F.when(F.col("freshness_seconds").isNotNull(), freshness_label(F.col("freshness_seconds"),
                                                                                      rules)).alias("freshness_label"),
                      "system_health_score", health_band(F.col("system_health_score"), rules).alias("health_band"))


def to_display_time(df: DataFrame, ts: str, tz: str = DISPLAY_TZ) -> DataFrame:
    """Add ``<ts>_local`` in the display time zone (labels only; storage stays UTC)."""
    return df.withColumn(f"{ts}_local", F.from_utc_timestamp(F.col(ts), tz))
