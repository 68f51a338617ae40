"""Registered sensor-domain queries (B, C, D) with their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from coldlake import oracle_sql as O
from coldlake.operators import ops_reports as R
from coldlake.operators import ops_view as V
from coldlake.plans.catalog import Catalog

NOW = "2024-02-01 00:00:00"   # report clock for freshness (the reference uses wall-clock time)

# name -> (spark builder taking a Catalog, oracle SQL or None)
QUERIES: dict[str, tuple] = {}


def q(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ B: pipeline outputs

@q("B03_rejected_events", O.sensor("""
SELECT event_id, rejection_reason, rejected_at FROM rejects"""))
def _b03(c: Catalog):
    return c.rejects.select("event_id", "rejection_reason", "rejected_at")


@q("B06_fact_sensor_reading", O.sensor("""
SELECT event_id, event_timestamp, shipment_id, vehicle_id, temperature_c, humidity_pct, latitude, longitude,
       door_open, battery_pct, speed_kmh, temperature_status, risk_score, risk_level, anomaly_flag, processed_at
FROM fact"""))
def _b06(c: Catalog):
    return c.fact


@q("B07_incidents", O.sensor("""
SELECT event_id, shipment_id, vehicle_id, incident_type, severity, incident_timestamp, description FROM incidents"""))
def _b07(c: Catalog):
    return c.incidents.drop("incident_id")


@q("B09_pipeline_runs", O.sensor("""
SELECT started_at, finished_at, rows_generated, rows_processed, rows_rejected, incidents_created, status FROM runs"""))
def _b09(c: Catalog):
    return c.runs.drop("run_id")


@q("B10_data_quality_results", O.sensor("""
SELECT check_name, records_checked, failures, status, created_at FROM quality"""))
def _b10(c: Catalog):
    return c.quality.select("check_name", "records_checked", "failures", "status", "created_at")


@q("B12_raw_sensor_events", O.sensor("""
SELECT event_id, event_timestamp, shipment_id, vehicle_id, warehouse, destination, food_category, temperature_c,
       humidity_pct, latitude, longitude, door_open, battery_pct, speed_kmh, delivery_status, run_time AS ingested_at
FROM raw"""))
def _b12(c: Catalog):
    return c.raw


# ------------------------------------------------------------------ C: reports

@q("C01_top_kpis", O.sensor("""
SELECT count(DISTINCT shipment_id) AS total_shipments, count(DISTINCT vehicle_id) AS active_vehicles,
       count(*) AS total_readings,
       count(DISTINCT shipment_id) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS at_risk_shipments,
       coalesce(round_even(100.0::DOUBLE * count(*) FILTER (WHERE temperature_status = 'SAFE') / count(*), 1), 0.0)
         AS temperature_compliance,
       coalesce(round_even(avg(risk_score), 1), 0.0) AS avg_risk_score
FROM fact"""))
def _c01(c: Catalog):
    return R.top_kpis(c.fact)


@q("C02_second_kpis", O.sensor("""
SELECT (SELECT count(*) FROM incidents WHERE severity = 'HIGH') AS critical_incidents,
       (SELECT count(*) FROM incidents WHERE severity IN ('MEDIUM', 'LOW')) AS warning_incidents,
       (SELECT coalesce(round_even(avg(temperature_c), 2), 0.0) FROM fact) AS avg_temperature,
       (SELECT coalesce(round_even(avg(humidity_pct), 1), 0.0) FROM fact) AS avg_humidity,
       (SELECT count(DISTINCT vehicle_id) FROM fact WHERE battery_pct < 30) AS low_battery_vehicles,
       (SELECT round_even(CASE WHEN coalesce(sum(records_checked), 0) = 0 THEN 100.0
                  ELSE greatest(0.0, 100.0 - sum(failures)::DOUBLE / sum(records_checked) * 100.0) END, 1)
        FROM quality WHERE run_id = (SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1))
         AS data_quality_score"""))
def _c02(c: Catalog):
    return R.second_kpis(c.fact, c.incidents, c.runs, c.quality)


def _recent_sql(cols: str) -> str:
    return O.sensor(f"""
SELECT event_timestamp, {cols}, shipment_id, vehicle_id FROM fact
ORDER BY event_timestamp DESC, event_id DESC LIMIT 200""")


@q("C03_recent_temperature", _recent_sql("temperature_c, temperature_status"))
def _c03(c: Catalog):
    return R.recent_temperature(c.fact)


@q("C04_recent_humidity", _recent_sql("humidity_pct, temperature_status"))
def _c04(c: Catalog):
    return R.recent_humidity(c.fact)


@q("C05_recent_battery", _recent_sql("battery_pct, risk_level"))
def _c05(c: Catalog):
    return R.recent_battery(c.fact)


@q("C06_recent_risk", _recent_sql("risk_score, risk_level"))
def _c06(c: Catalog):
    return R.recent_risk(c.fact)


@q("C07a_compliance_distribution", O.sensor("""
SELECT temperature_status AS status, count(*) AS count FROM fact GROUP BY temperature_status"""))
def _c07a(c: Catalog):
    return R.compliance_distribution(c.fact)


@q("C07b_risk_distribution", O.sensor("""
SELECT risk_level, count(DISTINCT shipment_id) AS count FROM fact GROUP BY risk_level"""))
def _c07b(c: Catalog):
    return R.risk_distribution(c.fact)


def _by_dim_sql(key: str) -> str:
    return O.sensor(f"""
SELECT ds.{key} AS {key}, round_even(avg(f.risk_score), 6) AS avg_risk,
       round_even(100.0::DOUBLE * count(*) FILTER (WHERE f.temperature_status = 'SAFE') / count(*), 6) AS compliance_pct
FROM fact f JOIN dim_shipment ds ON ds.shipment_id = f.shipment_id GROUP BY ds.{key}""")


@q("C08_risk_by_warehouse", _by_dim_sql("warehouse"))
def _c08(c: Catalog):
    return R.risk_by_warehouse(c.fact, c.dim_shipment)


@q("C09_risk_by_food_category", _by_dim_sql("food_category"))
def _c09(c: Catalog):
    return R.risk_by_food_category(c.fact, c.dim_shipment)


@q("C10_vehicle_health", O.sensor("""
SELECT vehicle_id, round_even(avg(risk_score), 6) AS avg_risk, round_even(avg(battery_pct), 6) AS avg_battery,
       round_even(100.0::DOUBLE * count(*) FILTER (WHERE temperature_status = 'SAFE') / count(*), 6) AS compliance_pct
FROM fact GROUP BY vehicle_id"""))
def _c10(c: Catalog):
    return R.vehicle_health(c.fact)


@q("C11_latest_vehicle_locations", O.sensor("""
SELECT vehicle_id, latitude, longitude, temperature_c, risk_level, event_timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM fact)
WHERE rn = 1"""))
def _c11(c: Catalog):
    return R.latest_vehicle_locations(c.fact)


SHIPMENT_HEALTH_SQL = """
sh_base AS (
  SELECT shipment_id, avg(risk_score) AS avg_risk,
         100.0::DOUBLE * count(*) FILTER (WHERE temperature_status = 'SAFE') / count(*) AS temp_compliance,
         avg(battery_pct) AS avg_battery,
         100.0::DOUBLE * count(*) FILTER (WHERE door_open = 0) / count(*) AS door_discipline
  FROM fact GROUP BY shipment_id
),
sh AS (
  SELECT *, round_even(temp_compliance * 0.4::DOUBLE + (100.0::DOUBLE - avg_risk) * 0.3::DOUBLE
                       + avg_battery * 0.15::DOUBLE + door_discipline * 0.15::DOUBLE, 1) AS health_score
  FROM sh_base
)"""


@q("C12_shipment_health", O.sensor(", " + SHIPMENT_HEALTH_SQL.strip() + """
SELECT shipment_id, round_even(avg_risk, 6) AS avg_risk, round_even(temp_compliance, 6) AS temp_compliance,
       round_even(avg_battery, 6) AS avg_battery, round_even(door_discipline, 6) AS door_discipline, health_score,
       CASE WHEN health_score >= 75 THEN 'HEALTHY' WHEN health_score >= 50 THEN 'WATCH' ELSE 'AT RISK' END AS status
FROM sh"""))
def _c12(c: Catalog):
    return R.shipment_health(c.fact)


@q("C13_recent_incidents", O.sensor("""
SELECT incident_timestamp, shipment_id, vehicle_id, incident_type, severity, description FROM incidents
ORDER BY incident_timestamp DESC, event_id DESC, incident_type DESC LIMIT 20"""))
def _c13(c: Catalog):
    return R.recent_incidents(c.incidents)


@q("C14_incident_severity_counts", O.sensor("""
SELECT severity, count(*) AS count FROM incidents GROUP BY severity"""))
def _c14(c: Catalog):
    return R.incident_severity_counts(c.incidents)


@q("C15_incident_type_counts", O.sensor("""
SELECT incident_type, count(*) AS count FROM incidents GROUP BY incident_type"""))
def _c15(c: Catalog):
    return R.incident_type_counts(c.incidents)


@q("C16_pipeline_health", O.sensor("""
SELECT CAST(coalesce(sum(rows_generated), 0) AS BIGINT) AS records_generated,
       CAST(coalesce(sum(rows_processed), 0) AS BIGINT) AS records_processed,
       CAST(coalesce(sum(rows_rejected), 0) AS BIGINT) AS records_rejected,
       CASE WHEN coalesce(sum(rows_generated), 0) = 0 THEN 100.0
            ELSE round_even(100.0::DOUBLE * sum(rows_processed) / sum(rows_generated), 1) END
         AS processing_success_rate,
       count(*) AS total_runs,
       coalesce((SELECT status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1), 'N/A') AS last_run_status,
       (SELECT finished_at FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1) AS last_run_finished_at
FROM runs"""))
def _c16(c: Catalog):
    return R.pipeline_health(c.runs)


@q("C17_recent_pipeline_runs", O.sensor("""
SELECT started_at, finished_at, rows_generated, rows_processed, rows_rejected, incidents_created, status
FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 10"""))
def _c17(c: Catalog):
    return R.recent_pipeline_runs(c.runs)


@q("C18a_data_quality_summary", O.sensor("""
SELECT check_name, CAST(sum(records_checked) AS BIGINT) AS records_checked, CAST(sum(failures) AS BIGINT) AS failures,
       CASE WHEN sum(failures) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM quality GROUP BY check_name"""))
def _c18a(c: Catalog):
    return R.data_quality_summary(c.quality)


@q("C18b_rejection_reasons", O.sensor("""
SELECT rejection_reason, count(*) AS count FROM rejects GROUP BY rejection_reason"""))
def _c18b(c: Catalog):
    return R.rejection_reasons(c.rejects)


@q("C19_status_by_warehouse", O.sensor("""
SELECT r.warehouse AS warehouse, count(*) AS readings, round_even(avg(f.risk_score), 6) AS avg_risk
FROM fact f JOIN raw r ON r.event_id = f.event_id GROUP BY r.warehouse"""))
def _c19(c: Catalog):
    return R.status_by_warehouse(c.fact, c.raw)


@q("C20_data_freshness_seconds", O.sensor(f"""
SELECT CASE WHEN count(event_timestamp) > 0
            THEN greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(event_timestamp)), 0) / 1e6::DOUBLE END
  AS freshness_seconds FROM fact"""))
def _c20(c: Catalog):
    return R.data_freshness_seconds(c.fact, F.to_timestamp(F.lit(NOW)))


@q("C21_delivery_status_counts", O.sensor("""
SELECT delivery_status, count(*) AS count FROM raw GROUP BY delivery_status"""))
def _c21(c: Catalog):
    return R.delivery_status_counts(c.raw)


@q("C22_anomaly_rate", O.sensor("""
SELECT coalesce(round_even(100.0::DOUBLE * sum(anomaly_flag) / count(*), 1), 0.0) AS anomaly_rate FROM fact"""))
def _c22(c: Catalog):
    return R.anomaly_rate(c.fact)


@q("C23_risk_score_distribution", O.sensor("""
SELECT CAST(trunc(risk_score / 5) AS INTEGER) * 5 AS bucket, count(*) AS count FROM fact GROUP BY 1"""))
def _c23(c: Catalog):
    return R.risk_score_distribution(c.fact)


@q("C24_speed_distribution", O.sensor("""
SELECT CAST(trunc(speed_kmh / 10) AS INTEGER) * 10 AS bucket, count(*) AS count FROM fact GROUP BY 1"""))
def _c24(c: Catalog):
    return R.speed_distribution(c.fact)


@q("C25_temperature_risk_scatter", O.sensor("""
SELECT f.temperature_c, f.risk_score, ds.food_category, f.risk_level, f.shipment_id
FROM fact f JOIN dim_shipment ds ON ds.shipment_id = f.shipment_id
ORDER BY f.event_timestamp DESC, f.event_id DESC LIMIT 300"""))
def _c25(c: Catalog):
    return R.temperature_risk_scatter(c.fact, c.dim_shipment)


@q("C26_status_over_time", O.sensor("""
SELECT strftime(event_timestamp, '%Y-%m-%dT%H:%M') AS minute, temperature_status, count(*) AS count
FROM fact GROUP BY 1, 2"""))
def _c26(c: Catalog):
    return R.status_over_time(c.fact)


@q("C27_door_open_trend", O.sensor("""
SELECT strftime(event_timestamp, '%Y-%m-%dT%H:%M') AS minute, CAST(sum(door_open) AS BIGINT) AS door_opens,
       count(*) AS total
FROM fact GROUP BY 1"""))
def _c27(c: Catalog):
    return R.door_open_trend(c.fact)


@q("C28_hourly_reading_counts", O.sensor("""
SELECT strftime(event_timestamp, '%Y-%m-%dT%H') AS hour, count(*) AS count FROM fact GROUP BY 1"""))
def _c28(c: Catalog):
    return R.hourly_reading_counts(c.fact)


@q("C29_incident_timeline", O.sensor("""
SELECT incident_timestamp, severity, incident_type, shipment_id, vehicle_id FROM incidents
ORDER BY incident_timestamp DESC, event_id DESC, incident_type DESC LIMIT 50"""))
def _c29(c: Catalog):
    return R.incident_timeline(c.incidents)


@q("C30_pipeline_throughput", O.sensor("""
SELECT started_at, rows_generated, rows_processed, rows_rejected, incidents_created
FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 25"""))
def _c30(c: Catalog):
    return R.pipeline_throughput(c.runs)


@q("C31_warehouse_comparison", O.sensor("""
SELECT r.warehouse AS warehouse, count(*) AS readings, round_even(avg(f.risk_score), 6) AS avg_risk,
       round_even(100.0::DOUBLE * count(*) FILTER (WHERE f.temperature_status = 'SAFE') / count(*), 6) AS compliance_pct
FROM fact f JOIN raw r ON r.event_id = f.event_id GROUP BY r.warehouse"""))
def _c31(c: Catalog):
    return R.warehouse_comparison(c.fact, c.raw)


@q("C32_food_category_compliance", O.sensor("""
SELECT ds.food_category AS food_category,
       round_even(100.0::DOUBLE * count(*) FILTER (WHERE f.temperature_status = 'SAFE') / count(*), 6) AS compliance_pct,
       round_even(avg(f.humidity_pct), 6) AS avg_humidity, round_even(avg(f.risk_score), 6) AS avg_risk
FROM fact f JOIN dim_shipment ds ON ds.shipment_id = f.shipment_id GROUP BY ds.food_category"""))
def _c32(c: Catalog):
    return R.food_category_compliance(c.fact, c.dim_shipment)


@q("C33_warehouse_food_risk_flow", O.sensor("""
SELECT r.warehouse AS warehouse, ds.food_category AS food_category, f.risk_level AS risk_level, count(*) AS count
FROM fact f JOIN raw r ON r.event_id = f.event_id JOIN dim_shipment ds ON ds.shipment_id = f.shipment_id
GROUP BY 1, 2, 3"""))
def _c33(c: Catalog):
    return R.warehouse_food_risk_flow(c.fact, c.raw, c.dim_shipment)


def corr_sql(source: str, columns: list[str]) -> str:
    parts = []
    for a in columns:
        for b in columns:
            if a == b:
                expr = f"CASE WHEN stddev_pop({a}::DOUBLE) > 0 THEN 1.0::DOUBLE END"
            else:
                expr = (f"round_even(covar_pop({a}::DOUBLE, {b}::DOUBLE) / "
                        f"nullif(stddev_pop({a}::DOUBLE) * stddev_pop({b}::DOUBLE), 0), 2) + 0.0::DOUBLE")
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, (SELECT {expr} FROM {source}) AS corr")
    return "\nUNION ALL ".join(parts)


@q("C34_correlation_matrix", O.sensor(corr_sql("fact", R.CORR_COLUMNS)))
def _c34(c: Catalog):
    return R.sensor_correlation_matrix(c.fact)


HEALTH_CTES = ", " + SHIPMENT_HEALTH_SQL.strip() + """,
qs AS (
  SELECT round_even(CASE WHEN coalesce(sum(records_checked), 0) = 0 THEN 100.0
            ELSE greatest(0.0, 100.0 - sum(failures)::DOUBLE / sum(records_checked) * 100.0) END, 1) AS q
  FROM quality WHERE run_id = (SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1)
),
comp AS (
  SELECT coalesce(round_even(100.0::DOUBLE * count(*) FILTER (WHERE temperature_status = 'SAFE') / count(*), 1), 0.0)
    AS c FROM fact
),
health AS (
  SELECT CASE WHEN (SELECT count(*) FROM sh) = 0 THEN 0.0 ELSE
    round_even((SELECT c FROM comp) * 0.35::DOUBLE + (SELECT avg(health_score) FROM sh) * 0.35::DOUBLE
               + (SELECT q FROM qs) * 0.30::DOUBLE, 1) END AS system_health_score
)
"""


@q("C35_system_health_score", O.sensor(HEALTH_CTES + "SELECT system_health_score FROM health"))
def _c35(c: Catalog):
    return R.system_health_score(c.fact, c.runs, c.quality)


# ------------------------------------------------------------------ D: values derived in the view

@q("D01_checks_passed", O.sensor("""
SELECT count(*) FILTER (WHERE st = 'PASS') AS checks_passed, count(*) AS checks_total FROM (
  SELECT check_name, CASE WHEN sum(failures) = 0 THEN 'PASS' ELSE 'FAIL' END AS st FROM quality GROUP BY check_name)"""))
def _d01(c: Catalog):
    return V.checks_passed(c.quality)


@q("D02_total_rejections", O.sensor("SELECT count(*) AS total_rejections FROM rejects"))
def _d02(c: Catalog):
    return V.total_rejections(c.rejects)


@q("D03_leaders", O.sensor("""
SELECT coalesce((SELECT incident_type FROM incidents GROUP BY incident_type ORDER BY count(*) DESC, incident_type
                 LIMIT 1), 'None') AS top_incident_type,
       coalesce((SELECT r.warehouse FROM fact f JOIN raw r ON r.event_id = f.event_id GROUP BY r.warehouse
                 ORDER BY avg(f.risk_score) DESC, r.warehouse LIMIT 1), 'N/A') AS riskiest_warehouse,
       coalesce((SELECT vehicle_id FROM fact GROUP BY vehicle_id ORDER BY avg(risk_score) DESC,
                 vehicle_id LIMIT 1), 'N/A') AS riskiest_vehicle"""))
def _d03(c: Catalog):
    return V.leaders(c.fact, c.incidents, c.raw)


@q("D04_in_transit_count", O.sensor(
    "SELECT count(*) FILTER (WHERE delivery_status = 'IN_TRANSIT') AS in_transit FROM raw"))
def _d04(c: Catalog):
    return V.in_transit_count(c.raw)


@q("D05_fleet_avg_battery", O.sensor("""
SELECT coalesce(round_even(avg(b), 1), 0.0) AS fleet_avg_battery FROM (
  SELECT vehicle_id, avg(battery_pct) AS b FROM fact GROUP BY vehicle_id)"""))
def _d05(c: Catalog):
    return V.fleet_avg_battery(c.fact)


@q("D06_shipment_health_summary", O.sensor(", " + SHIPMENT_HEALTH_SQL.strip() + """
SELECT count(*) FILTER (WHERE health_score >= 75) AS healthy_shipments,
       count(*) FILTER (WHERE health_score < 50) AS at_risk_shipments,
       coalesce(round_even(avg(health_score), 1), 0.0) AS avg_health_score,
       (SELECT count(*) FROM incidents) AS total_incidents
FROM sh"""))
def _d06(c: Catalog):
    return V.shipment_health_summary(c.fact, c.incidents)


@q("D07_safe_share", O.sensor("""
SELECT coalesce(round_even(100.0::DOUBLE * count(*) FILTER (WHERE temperature_status = 'SAFE') / count(*), 1), 0.0)
  AS safe_pct FROM fact"""))
def _d07(c: Catalog):
    return V.safe_share(c.fact)


@q("D07b_risk_levels_ordered", O.sensor("""
SELECT risk_level, count(DISTINCT shipment_id) AS count FROM fact GROUP BY risk_level"""))
def _d07b(c: Catalog):
    return V.risk_levels_ordered(c.fact)


@q("D08_flow_edges", O.sensor("""
, flow AS (
  SELECT r.warehouse AS warehouse, ds.food_category AS food_category, f.risk_level AS risk_level, count(*) AS n
  FROM fact f JOIN raw r ON r.event_id = f.event_id JOIN dim_shipment ds ON ds.shipment_id = f.shipment_id
  GROUP BY 1, 2, 3)
SELECT warehouse AS source, food_category AS target, CAST(sum(n) AS BIGINT) AS value, 1 AS stage FROM flow GROUP BY 1, 2
UNION ALL
SELECT food_category, risk_level, CAST(sum(n) AS BIGINT), 2 FROM flow GROUP BY 1, 2"""))
def _d08(c: Catalog):
    return V.flow_edges(c.fact, c.raw, c.dim_shipment)


@q("D09_fleet_radar", O.sensor(", " + SHIPMENT_HEALTH_SQL.strip() + """
SELECT 'Temp Compliance' AS axis, round_even(avg(temp_compliance), 6) AS value FROM sh
UNION ALL SELECT 'Risk Safety', round_even(100.0 - avg(avg_risk), 6) FROM sh
UNION ALL SELECT 'Battery', round_even(avg(avg_battery), 6) FROM sh
UNION ALL SELECT 'Door Discipline', round_even(avg(door_discipline), 6) FROM sh"""))
def _d09(c: Catalog):
    return V.fleet_radar(c.fact)


@q("D10_status_pivot", O.sensor("""
SELECT strftime(event_timestamp, '%Y-%m-%dT%H:%M') AS minute,
       count(*) FILTER (WHERE temperature_status = 'SAFE') AS SAFE,
       count(*) FILTER (WHERE temperature_status = 'WARNING') AS WARNING,
       count(*) FILTER (WHERE temperature_status = 'CRITICAL') AS CRITICAL
FROM fact GROUP BY 1"""))
def _d10(c: Catalog):
    return V.status_pivot(c.fact)


@q("D11_throughput_indexed", O.sensor("""
SELECT started_at, rows_generated, rows_processed, rows_rejected, incidents_created,
       CAST(row_number() OVER (ORDER BY started_at) AS INTEGER) AS run_index
FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 25)"""))
def _d11(c: Catalog):
    return V.throughput_indexed(c.runs)


@q("D12_worst_shipments", O.sensor(", " + SHIPMENT_HEALTH_SQL.strip() + """
SELECT shipment_id, health_score, round_even(avg_risk, 1) AS avg_risk,
       round_even(temp_compliance, 1) AS temp_compliance,
       CASE WHEN health_score >= 75 THEN 'HEALTHY' WHEN health_score >= 50 THEN 'WATCH' ELSE 'AT RISK' END AS status
FROM sh ORDER BY health_score, shipment_id LIMIT 15"""))
def _d12(c: Catalog):
    return V.worst_shipments(c.fact)


@q("D13_status_labels", O.sensor(HEALTH_CTES.rstrip() + f""",
fresh AS (
  SELECT CASE WHEN count(event_timestamp) > 0
              THEN greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(event_timestamp)), 0) / 1e6::DOUBLE END AS s
  FROM fact
)
SELECT s AS freshness_seconds,
       CASE WHEN s < 10 THEN 'HEALTHY' WHEN s < 30 THEN 'WARNING' WHEN s IS NOT NULL THEN 'CRITICAL' END AS freshness_label,
       system_health_score,
       CASE WHEN system_health_score >= 75 THEN 'SAFE' WHEN system_health_score >= 50 THEN 'WARNING' ELSE 'CRITICAL' END
         AS health_band
FROM fresh, health"""))
def _d13(c: Catalog):
    return V.status_labels(c.fact, c.runs, c.quality, F.to_timestamp(F.lit(NOW)))


@q("D14_recent_temperature_local", O.sensor("""
SELECT event_timestamp, temperature_c, temperature_status, shipment_id, vehicle_id,
       event_timestamp + INTERVAL '5 hours 30 minutes' AS event_timestamp_local
FROM fact ORDER BY event_timestamp DESC, event_id DESC LIMIT 200"""))
def _d14(c: Catalog):
    return V.to_display_time(R.recent_temperature(c.fact), "event_timestamp")


# ------------------------------------------------------------------ A16, B11

@q("A16_shipment_bounds", O.sensor("""
SELECT d.shipment_id, d.food_category, d.warehouse, d.destination, coalesce(r.lo, -30.0) AS required_min_temp,
       coalesce(r.hi, 30.0) AS required_max_temp
FROM dim_shipment d LEFT JOIN temp_ranges r ON r.cat = d.food_category"""))
def _a16(c: Catalog):
    return c.dim_shipment.drop("created_at")


@q("B11_run_report", O.sensor("""
SELECT run_id, rows_generated, rows_processed, rows_rejected, incidents_created FROM runs"""))
def _b11(c: Catalog):
    return c.runs.select("run_id", "rows_generated", "rows_processed", "rows_rejected", "incidents_created")
