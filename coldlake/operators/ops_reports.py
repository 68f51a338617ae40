"""Operations reports over the curated sensor tables.

Each function takes the tables it reads as DataFrames and returns a DataFrame
(scalar KPIs become one-row frames). Large-table joins are avoided where the
grouping allows: readings are pre-aggregated to shipment grain before they meet
``dim_shipment`` (aggregation pushed below the join), so the join input is bounded
by the number of shipments, not readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_RULES, Rules
from coldlake.functions.numeric import count_when, half_even, pct, truncate_bucket
from coldlake.functions.periods import hour_label, minute_label
from coldlake.operators.common import attach_scalars, last_k_ascending, stat, top_k

RECENT_LIMIT = 200


def _safe() -> Column:
    return F.col("temperature_status") == F.lit("SAFE")


# ---------------------------------------------------------------- KPIs

def top_kpis(fact: DataFrame) -> DataFrame:
    """C1. Pre-aggregates to (shipment, vehicle) grain, then counts distinct members of that
    small frame: one shuffle of partial aggregates instead of one Expand per distinct count."""
    at_risk = F.col("risk_level").isin("HIGH", "CRITICAL")
    pairs = fact.groupBy("shipment_id", "vehicle_id").agg(
        F.count(F.lit(1)).alias("n"), count_when(_safe()).alias("safe_n"),
        F.sum("risk_score").alias("risk_sum"), F.max(at_risk.cast("int")).alias("any_risk"))
    return top_kpis_of(pairs)


def top_kpis_of(pairs: DataFrame) -> DataFrame:
    """C1 from (shipment, vehicle) rows with n, safe_n, risk_sum and any_risk."""
    return pairs.agg(
        F.count_distinct("shipment_id").alias("total_shipments"),
        F.count_distinct("vehicle_id").alias("active_vehicles"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_readings"),
        F.count_distinct(F.when(F.col("any_risk") == 1, F.col("shipment_id"))).alias("at_risk_shipments"),
        F.coalesce(half_even(pct(F.sum("safe_n"), F.sum("n")), 1), F.lit(0.0)).alias("temperature_compliance"),
        F.coalesce(half_even(F.try_divide(F.sum("risk_sum"), F.sum("n")), 1), F.lit(0.0)).alias("avg_risk_score"),
    )


def latest_run_id(runs: DataFrame) -> DataFrame:
    """One row: the run with the greatest start time (ties broken by run_id)."""
    return runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def quality_score(runs: DataFrame, quality: DataFrame) -> DataFrame:
    """max(0, 100 - failures / checked * 100) over the latest run's checks; 100 without runs."""
    latest = quality.join(latest_run_id(runs), "run_id", "left_semi")
    agg = latest.agg(F.sum("records_checked").alias("checked"), F.sum("failures").alias("failed"))
    return agg.select(quality_score_of("checked", "failed").alias("data_quality_score"))


def quality_score_of(checked: str, failed: str) -> Column:
    score = F.when(F.coalesce(F.col(checked), F.lit(0)) == 0, F.lit(100.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(100.0) - F.try_divide(F.col(failed).cast("double"), F.col(checked)) * F.lit(100.0)))
    return half_even(score, 1)


def second_kpis(fact: DataFrame, incidents: DataFrame, runs: DataFrame, quality: DataFrame) -> DataFrame:
    """Incident severities, average conditions, low-battery vehicles, latest-run quality."""
    inc = incidents.agg(
        F.count_if(F.col("severity") == "HIGH").alias("critical_incidents"),
        F.count_if(F.col("severity").isin("MEDIUM", "LOW")).alias("warning_incidents"))
    cond = fact.agg(
        F.coalesce(half_even(F.avg("temperature_c"), 2), F.lit(0.0)).alias("avg_temperature"),
        F.coalesce(half_even(F.avg("humidity_pct"), 1), F.lit(0.0)).alias("avg_humidity"),
        F.count_distinct(F.when(F.col("battery_pct") < 30, F.col("vehicle_id"))).alias("low_battery_vehicles"))
    out = attach_scalars(inc, cond, quality_score(runs, quality))
    return out.select("critical_incidents", "warning_incidents", "avg_temperature", "avg_humidity",
                      "low_battery_vehicles", "data_quality_score")


# ---------------------------------------------------------------- recent series

def recent_readings(fact: DataFrame, value_cols: list[str], limit: int = RECENT_LIMIT) -> DataFrame:
    """The newest ``limit`` readings, oldest first, with the given value columns."""
    cols = ["event_timestamp", *value_cols, "shipment_id", "vehicle_id", "event_id"]
    out = last_k_ascending(fact.select(*cols), limit, "event_timestamp", ["event_id"])
    return out.select(*[c for c in cols if c != "event_id"])


def recent_temperature(fact: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return recent_readings(fact, ["temperature_c", "temperature_status"], limit)


def recent_humidity(fact: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return recent_readings(fact, ["humidity_pct", "temperature_status"], limit)


def recent_battery(fact: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return recent_readings(fact, ["battery_pct", "risk_level"], limit)


def recent_risk(fact: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return recent_readings(fact, ["risk_score", "risk_level"], limit)


# ---------------------------------------------------------------- distributions

def compliance_distribution(fact: DataFrame) -> DataFrame:
    """C7a."""
    return fact.groupBy(F.col("temperature_status").alias("status")).agg(F.count(F.lit(1)).alias("count"))


def risk_distribution(fact: DataFrame) -> DataFrame:
    """Distinct shipments per risk level (a shipment counts once per level it reached)."""
    return fact.groupBy("risk_level").agg(F.count_distinct("shipment_id").alias("count"))


def _by_shipment(fact: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    return fact.groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("n"), count_when(_safe()).alias("safe_n"), F.sum("risk_score").alias("risk_sum"),
        *(extra or []))


def _risk_by_dim(fact: DataFrame, dim_shipment: DataFrame, key: str) -> DataFrame:
    return risk_by_dim_of(_by_shipment(fact), dim_shipment, key)


def risk_by_dim_of(by_shipment: DataFrame, dim_shipment: DataFrame, key: str) -> DataFrame:
    """C8 / C9 from rows per shipment with n, safe_n and risk_sum."""
    per = by_shipment.join(dim_shipment.select("shipment_id", key), "shipment_id")
    return (per.groupBy(key).agg(
        stat(F.try_divide(F.sum("risk_sum"), F.sum("n"))).alias("avg_risk"),
        stat(pct(F.sum("safe_n"), F.sum("n"))).alias("compliance_pct"))
        .orderBy(F.col("avg_risk").desc(), F.col(key)))


def risk_by_warehouse(fact: DataFrame, dim_shipment: DataFrame) -> DataFrame:
    """By the shipment's (dimension) warehouse."""
    return _risk_by_dim(fact, dim_shipment, "warehouse")


def risk_by_food_category(fact: DataFrame, dim_shipment: DataFrame) -> DataFrame:
    """By the shipment's (dimension) category."""
    return _risk_by_dim(fact, dim_shipment, "food_category")


def vehicle_health(fact: DataFrame) -> DataFrame:
    """C10."""
    return (fact.groupBy("vehicle_id").agg(
        stat(F.avg("risk_score")).alias("avg_risk"), stat(F.avg("battery_pct")).alias("avg_battery"),
        stat(pct(count_when(_safe()), F.count(F.lit(1)))).alias("compliance_pct"))
        .orderBy(F.col("avg_risk").desc(), "vehicle_id"))


def latest_vehicle_locations(fact: DataFrame) -> DataFrame:
    """C11: one latest reading per vehicle (ties on time -> greatest event_id); an aggregate, no self-join."""
    latest = fact.groupBy("vehicle_id").agg(F.max_by(
        F.struct("latitude", "longitude", "temperature_c", "risk_level", "event_timestamp"),
        F.struct("event_timestamp", "event_id")).alias("r"))
    return latest.select("vehicle_id", "r.latitude", "r.longitude", "r.temperature_c", "r.risk_level",
                         "r.event_timestamp")


def shipment_health_exact(fact: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Per-shipment unrounded statistics with the rounded health score and its band."""
    n = F.count(F.lit(1))
    per = fact.groupBy("shipment_id").agg(
        F.avg("risk_score").alias("avg_risk"),
        pct(count_when(_safe()), n).alias("temp_compliance"),
        F.avg("battery_pct").alias("avg_battery"),
        pct(count_when(F.col("door_open") == 0), n).alias("door_discipline"))
    return _with_health(per, rules)


def _with_health(per: DataFrame, rules: Rules) -> DataFrame:
    health = half_even(F.col("temp_compliance") * F.lit(0.4) + (F.lit(100.0) - F.col("avg_risk")) * F.lit(0.3)
                       + F.col("avg_battery") * F.lit(0.15) + F.col("door_discipline") * F.lit(0.15), 1)
    return per.withColumn("health_score", health).withColumn(
        "status", F.when(F.col("health_score") >= rules.health_healthy, F.lit("HEALTHY"))
        .when(F.col("health_score") >= rules.health_watch, F.lit("WATCH")).otherwise(F.lit("AT RISK")))


def shipment_health(fact: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Per-shipment health score and band (band judged on the rounded score), ascending."""
    return _health_rows(shipment_health_exact(fact, rules))


def shipment_health_of(per: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """C12 from each shipment's unrounded averages."""
    return _health_rows(_with_health(per, rules))


def _health_rows(out: DataFrame) -> DataFrame:
    return out.select("shipment_id", *[stat(F.col(c)).alias(c) for c in
                                       ("avg_risk", "temp_compliance", "avg_battery", "door_discipline")],
                      "health_score", "status").orderBy("health_score", "shipment_id")


# ---------------------------------------------------------------- incidents

def recent_incidents(incidents: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first."""
    return top_k(incidents, limit, F.col("incident_timestamp").desc(), F.col("event_id").desc(),
                 F.col("incident_type").desc()).select(
        "incident_timestamp", "shipment_id", "vehicle_id", "incident_type", "severity", "description")


def incident_severity_counts(incidents: DataFrame) -> DataFrame:
    """C14."""
    return incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def incident_type_counts(incidents: DataFrame) -> DataFrame:
    """C15."""
    return (incidents.groupBy("incident_type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "incident_type"))


def incident_timeline(incidents: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` incidents, oldest first."""
    newest = top_k(incidents, limit, F.col("incident_timestamp").desc(), F.col("event_id").desc(),
                   F.col("incident_type").desc())
    return newest.orderBy("incident_timestamp", "event_id", "incident_type").select(
        "incident_timestamp", "severity", "incident_type", "shipment_id", "vehicle_id")


# ---------------------------------------------------------------- pipeline health

def pipeline_health(runs: DataFrame) -> DataFrame:
    """Totals over all runs plus the latest run's status and finish time."""
    agg = runs.agg(
        F.coalesce(F.sum("rows_generated"), F.lit(0)).cast("long").alias("records_generated"),
        F.coalesce(F.sum("rows_processed"), F.lit(0)).cast("long").alias("records_processed"),
        F.coalesce(F.sum("rows_rejected"), F.lit(0)).cast("long").alias("records_rejected"),
        F.count(F.lit(1)).alias("total_runs"),
        F.max_by(F.struct("status", "finished_at"), F.struct("started_at", "run_id")).alias("latest"))
    return pipeline_health_of(agg)


def pipeline_health_of(agg: DataFrame) -> DataFrame:
    """C16 from the totals and the latest run."""
    rate = F.when(F.col("records_generated") == 0, F.lit(100.0)).otherwise(
        half_even(pct("records_processed", "records_generated"), 1))
    return agg.select("records_generated", "records_processed", "records_rejected",
                      rate.alias("processing_success_rate"), "total_runs",
                      F.coalesce(F.col("latest.status"), F.lit("N/A")).alias("last_run_status"),
                      F.col("latest.finished_at").alias("last_run_finished_at"))


def recent_pipeline_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """C17: newest runs first."""
    return top_k(runs, limit, F.col("started_at").desc(), F.col("run_id").desc()).select(
        "started_at", "finished_at", "rows_generated", "rows_processed", "rows_rejected", "incidents_created",
        "status")


def pipeline_throughput(runs: DataFrame, limit: int = 25) -> DataFrame:
    """The newest ``limit`` runs, oldest first."""
    out = last_k_ascending(runs, limit, "started_at", ["run_id"])
    return out.select("started_at", "rows_generated", "rows_processed", "rows_rejected", "incidents_created")


def data_quality_summary(quality: DataFrame) -> DataFrame:
    """Per check over all runs."""
    return quality.groupBy("check_name").agg(
        F.sum("records_checked").cast("long").alias("records_checked"),
        F.sum("failures").cast("long").alias("failures"),
        F.when(F.sum("failures") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"))


def rejection_reasons(rejects: DataFrame) -> DataFrame:
    """C18b."""
    return (rejects.groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "rejection_reason"))


def data_freshness_seconds(fact: DataFrame, now: Column) -> DataFrame:
    """C20: seconds from the newest reading to ``now``, floored at 0; NULL without readings."""
    latest = fact.agg(F.max("event_timestamp").alias("latest"))
    secs = (F.unix_micros(now) - F.unix_micros(F.col("latest"))).cast("double") / F.lit(1e6)
    return latest.select(F.when(F.col("latest").isNotNull(), F.greatest(secs, F.lit(0.0))).alias("freshness_seconds"))


# ---------------------------------------------------------------- warehouse (event attribute) reports

def with_event_warehouse(fact: DataFrame, raw: DataFrame) -> DataFrame:
    return fact.join(raw.select("event_id", "warehouse"), "event_id")


def status_by_warehouse(fact: DataFrame, raw: DataFrame) -> DataFrame:
    """By the event's own warehouse (fact joined with raw on event_id)."""
    return (with_event_warehouse(fact, raw).groupBy("warehouse").agg(
        F.count(F.lit(1)).alias("readings"), stat(F.avg("risk_score")).alias("avg_risk"))
        .orderBy(F.col("avg_risk").desc(), "warehouse"))


def warehouse_comparison(fact: DataFrame, raw: DataFrame) -> DataFrame:
    """C19 plus SAFE share."""
    return (with_event_warehouse(fact, raw).groupBy("warehouse").agg(
        F.count(F.lit(1)).alias("readings"), stat(F.avg("risk_score")).alias("avg_risk"),
        stat(pct(count_when(_safe()), F.count(F.lit(1)))).alias("compliance_pct"))
        .orderBy(F.col("avg_risk").desc(), "warehouse"))


def delivery_status_counts(raw: DataFrame) -> DataFrame:
    """Over raw rows (rejected readings included)."""
    return raw.groupBy("delivery_status").agg(F.count(F.lit(1)).alias("count"))


def anomaly_rate(fact: DataFrame) -> DataFrame:
    """C22."""
    return fact.agg(F.coalesce(half_even(pct(F.sum("anomaly_flag"), F.count(F.lit(1))), 1), F.lit(0.0))
                    .alias("anomaly_rate"))


def risk_score_distribution(fact: DataFrame) -> DataFrame:
    """Width-5 buckets."""
    return (fact.groupBy(truncate_bucket("risk_score", 5).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy("bucket"))


def speed_distribution(fact: DataFrame) -> DataFrame:
    """Width-10 buckets."""
    return (fact.groupBy(truncate_bucket("speed_kmh", 10).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy("bucket"))


def temperature_risk_scatter(fact: DataFrame, dim_shipment: DataFrame, limit: int = 300) -> DataFrame:
    """Newest ``limit`` readings that have a shipment dimension row.

    The semi-join keeps inner-join semantics, the top-k runs before the attribute join,
    so only ``limit`` rows are joined with the dimension.
    """
    dim = dim_shipment.select("shipment_id", "food_category")
    matched = fact.join(dim.select("shipment_id"), "shipment_id", "left_semi")
    newest = top_k(matched.select("event_id", "event_timestamp", "temperature_c", "risk_score", "risk_level",
                                  "shipment_id"), limit, F.col("event_timestamp").desc(), F.col("event_id").desc())
    return newest.join(dim, "shipment_id").select("temperature_c", "risk_score", "food_category", "risk_level",
                                                  "shipment_id")


def status_over_time(fact: DataFrame) -> DataFrame:
    """Readings per (minute, status)."""
    return (fact.groupBy(minute_label("event_timestamp").alias("minute"), "temperature_status")
            .agg(F.count(F.lit(1)).alias("count")).orderBy("minute", "temperature_status"))


def door_open_trend(fact: DataFrame) -> DataFrame:
    """Door openings and readings per minute."""
    return (fact.groupBy(minute_label("event_timestamp").alias("minute"))
            .agg(F.sum("door_open").cast("long").alias("door_opens"), F.count(F.lit(1)).alias("total"))
            .orderBy("minute"))


def hourly_reading_counts(fact: DataFrame) -> DataFrame:
    """C28."""
    return (fact.groupBy(hour_label("event_timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy("hour"))


def food_category_compliance(fact: DataFrame, dim_shipment: DataFrame) -> DataFrame:
    """By dimension category, pre-aggregated per shipment before the join."""
    return food_category_compliance_of(_by_shipment(fact, [F.sum("humidity_pct").alias("hum_sum")]), dim_shipment)


def food_category_compliance_of(by_shipment: DataFrame, dim_shipment: DataFrame) -> DataFrame:
    """C32 from rows per shipment with n, safe_n, risk_sum and hum_sum."""
    per = by_shipment.join(dim_shipment.select("shipment_id", "food_category"), "shipment_id")
    return (per.groupBy("food_category").agg(
        stat(pct(F.sum("safe_n"), F.sum("n"))).alias("compliance_pct"),
        stat(F.try_divide(F.sum("hum_sum"), F.sum("n"))).alias("avg_humidity"),
        stat(F.try_divide(F.sum("risk_sum"), F.sum("n"))).alias("avg_risk"))
        .orderBy(F.col("compliance_pct").desc(), "food_category"))


def warehouse_food_risk_flow(fact: DataFrame, raw: DataFrame, dim_shipment: DataFrame) -> DataFrame:
    """Readings by (event warehouse, dimension category, risk level).

    Counted at (warehouse, shipment, level) grain first; only that small frame meets the dimension.
    """
    per = (with_event_warehouse(fact, raw).groupBy("warehouse", "shipment_id", "risk_level")
           .agg(F.count(F.lit(1)).alias("n")))
    return (per.join(dim_shipment.select("shipment_id", "food_category"), "shipment_id")
            .groupBy("warehouse", "food_category", "risk_level").agg(F.sum("n").cast("long").alias("count")))


CORR_COLUMNS = ["temperature_c", "humidity_pct", "battery_pct", "speed_kmh", "risk_score", "door_open"]


def correlation_shift(rules: Rules = DEFAULT_RULES) -> dict[str, float]:
    """Middle of each valid range: any constant near the data keeps the digits of the sums."""
    return {"temperature_c": (rules.temp_min + rules.temp_max) / 2, "humidity_pct": (rules.humidity_min + rules.humidity_max) / 2,
            "battery_pct": (rules.battery_min + rules.battery_max) / 2, "speed_kmh": (rules.speed_min + rules.speed_max) / 2,
            "risk_score": rules.score_cap / 2, "door_open": 0.5}


def correlation_long(df: DataFrame, columns: list[str], digits: int = 2, shift: dict[str, float] | None = None) -> DataFrame:
    """Pearson matrix in long form (var_x, var_y, corr) from ONE pass of shifted sums.

    Each column is shifted by a value near it, so that the sums of squares and products lose
    no digits: ``shift`` if given, else some row's own values (a one-row read); the result does
    not depend on which. A constant column gives NULL (pandas NaN). Rows with a NULL in any of
    the columns are dropped first (the validated tables have none). Diagonal = 1.0 unless the
    column is constant.
    """
    data = df.selectExpr(*[f"cast({c} as double) as {c}" for c in columns]).na.drop()
    if shift is None:
        some = data.limit(1).agg(F.struct(*[F.max(c).alias(c) for c in columns]).alias("m")).scalar()
        shifted = data.select(*[(F.col(c) - some[c]).alias(c) for c in columns])
    else:
        shifted = data.selectExpr(*[f"{c} - {float(shift[c])!r}D as {c}" for c in columns])
    sums = shifted.agg(*[F.expr(e) for e in [
        "count(1) as n", *[f"sum({c}) as s_{c}" for c in columns], *[f"max({c}) > min({c}) as varies_{c}" for c in columns],
        *[f"sum({a} * {b}) as p_{a}__{b}" for i, a in enumerate(columns) for b in columns[i:]]]])
    return correlation_of(sums, columns, digits)


def correlation_of(sums: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """The matrix from one row of shifted sums: n, s_x, p_x__y and varies_x.

    Pairs are exploded before the division and the rounding, which are then written once."""
    def moment(a: str, b: str) -> str:
        return f"p_{a}__{b} - try_divide(s_{a} * s_{b}, n)"

    spread = sums.selectExpr("*", *[f"CASE WHEN varies_{a} THEN {moment(a, a)} END AS m_{a}" for a in columns])
    pairs = ", ".join(f"struct('{a}' AS a, '{b}' AS b, {moment(a, b)} AS m, m_{a} AS ma, m_{b} AS mb)" for i, a in enumerate(columns) for b in columns[i:])
    pair = spread.selectExpr(f"inline(array({pairs}))")
    r = F.expr(f"CASE WHEN a <> b THEN bround(try_divide(m, sqrt(ma * mb)), {digits}) + 0D WHEN ma IS NOT NULL THEN 1D END")   # no negative zero
    return pair.select(r.alias("corr"), F.expr("explode(CASE WHEN a = b THEN array(struct(a AS x, b AS y)) ELSE array(struct(a AS x, b AS y), struct(b AS x, a AS y)) END)").alias("s")) \
        .selectExpr("s.x AS var_x", "s.y AS var_y", "corr")


def sensor_correlation_matrix(fact: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """C34."""
    return correlation_long(fact, CORR_COLUMNS, shift=correlation_shift(rules))


def system_health_score(fact: DataFrame, runs: DataFrame, quality: DataFrame) -> DataFrame:
    """.35 * compliance + .35 * mean shipment health + .30 * quality, from rounded inputs."""
    return system_health_of(shipment_health(fact), top_kpis(fact), quality_score(runs, quality))


def system_health_of(shipments: DataFrame, kpis: DataFrame, quality_row: DataFrame) -> DataFrame:
    """C35 from C12, C1 and the quality score."""
    health = shipments.agg(F.avg("health_score").alias("avg_health"), F.count(F.lit(1)).alias("n_shipments"))
    out = attach_scalars(health, kpis.select("temperature_compliance"), quality_row)
    score = (F.col("temperature_compliance") * F.lit(0.35) + F.col("avg_health") * F.lit(0.35)
             + F.col("data_quality_score") * F.lit(0.30))
    return out.select(F.when(F.col("n_shipments") == 0, F.lit(0.0)).otherwise(half_even(score, 1))
                      .alias("system_health_score"))
