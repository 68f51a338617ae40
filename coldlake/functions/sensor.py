"""Row-level rules of the sensor pipeline as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_RULES, DEFAULT_TEMP_RANGE, TEMP_RANGES, Rules


def _missing(c: str) -> Column:
    """A text value the reference treats as absent: NULL or empty."""
    return F.col(c).isNull() | (F.col(c) == F.lit(""))


def _outside(c: str, lo: float, hi: float) -> Column:
    # NaN compares greater than any number in Spark, so `> hi` also rejects NaN.
    x = F.col(c)
    return x.isNull() | (x < F.lit(lo)) | (x > F.lit(hi))


def rejection_reason(rules: Rules = DEFAULT_RULES) -> Column:
    """Ordered validation checks; the first failing one names the reason, NULL = valid."""
    r = rules
    coords_bad = _outside("latitude", -r.lat_abs_max, r.lat_abs_max) | _outside(
        "longitude", -r.lon_abs_max, r.lon_abs_max)
    return (
        F.when(_missing("shipment_id"), F.lit("null_shipment_id"))
        .when(_missing("vehicle_id"), F.lit("null_vehicle_id"))
        .when(F.col("event_timestamp").isNull(), F.lit("null_timestamp"))
        .when(_outside("temperature_c", r.temp_min, r.temp_max), F.lit("invalid_temperature"))
        .when(_outside("humidity_pct", r.humidity_min, r.humidity_max), F.lit("invalid_humidity"))
        .when(_outside("battery_pct", r.battery_min, r.battery_max), F.lit("invalid_battery_pct"))
        .when(_outside("speed_kmh", r.speed_min, r.speed_max), F.lit("invalid_speed"))
        .when(coords_bad, F.lit("invalid_coordinates"))
    )


def _range_map(ranges: dict[str, tuple[float, float]], idx: int) -> Column:
    kv = []
    for k, v in ranges.items():
        kv += [F.lit(k), F.lit(float(v[idx]))]
    return F.create_map(*kv)


def safe_bounds(category: str | Column = "food_category",
                ranges: dict[str, tuple[float, float]] | None = None) -> tuple[Column, Column]:
    """(low, high) of the category's safe range; the default range for unknown categories.

    A literal map lookup is a narrow, codegen'd expression: no join, no shuffle.
    """
    ranges = TEMP_RANGES if ranges is None else ranges
    cat = F.col(category) if isinstance(category, str) else category
    low = F.coalesce(F.try_element_at(_range_map(ranges, 0), cat), F.lit(DEFAULT_TEMP_RANGE[0]))
    high = F.coalesce(F.try_element_at(_range_map(ranges, 1), cat), F.lit(DEFAULT_TEMP_RANGE[1]))
    return low, high


def temperature_status(temp: str = "temperature_c", category: str = "food_category",
                       rules: Rules = DEFAULT_RULES, ranges: dict | None = None) -> Column:
    low, high = safe_bounds(category, ranges)
    t = F.col(temp)
    breach = F.least(F.abs(t - low), F.abs(t - high))
    return (F.when((t >= low) & (t <= high), F.lit("SAFE"))
            .when(breach > F.lit(rules.critical_breach), F.lit("CRITICAL"))
            .otherwise(F.lit("WARNING")))


def risk_score(status: str = "temperature_status", rules: Rules = DEFAULT_RULES) -> Column:
    """Additive risk points capped at the score cap (an integer, stored as double)."""
    r = rules
    s = F.col(status)

    def pts(cond: Column, n: int) -> Column:
        return F.when(cond, F.lit(n)).otherwise(F.lit(0))

    total = (
        F.when(s == F.lit("CRITICAL"), F.lit(r.points_critical))
        .when(s == F.lit("WARNING"), F.lit(r.points_warning)).otherwise(F.lit(0))
        + pts(F.coalesce(F.col("door_open"), F.lit(0)) != F.lit(0), r.points_door)
        + pts(F.col("humidity_pct") > F.lit(r.humidity_risk_above), r.points_humidity)
        + pts(F.col("battery_pct") < F.lit(r.battery_risk_below), r.points_battery)
        + pts(F.col("speed_kmh") > F.lit(r.speed_risk_above), r.points_speed)
    )
    return F.least(total, F.lit(r.score_cap)).cast("double")


def risk_level(score: str = "risk_score", rules: Rules = DEFAULT_RULES) -> Column:
    s = F.col(score)
    return (F.when(s >= F.lit(rules.level_critical), F.lit("CRITICAL"))
            .when(s >= F.lit(rules.level_high), F.lit("HIGH"))
            .when(s >= F.lit(rules.level_medium), F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def anomaly_flag(status: str = "temperature_status") -> Column:
    return (F.col(status) != F.lit("SAFE")).cast("int")


def incident_rules(rules: Rules = DEFAULT_RULES) -> list[tuple[str, Column, Column, Column]]:
    """The four incident rules as (incident_type, condition, severity, description).

    Requires temperature_status, risk_score, risk_level, door_open, battery_pct,
    temperature_c and food_category on the row.
    """
    r = rules
    score_txt = F.col("risk_score").cast("int").cast("string")
    return [
        ("TEMPERATURE_CRITICAL", F.col("temperature_status") == F.lit("CRITICAL"), F.lit("HIGH"),
         F.concat(F.lit("Temperature "), F.col("temperature_c").cast("string"),
                  F.lit("C outside safe range for "), F.coalesce(F.col("food_category"), F.lit("None")), F.lit("."))),
        ("HIGH_RISK", F.col("risk_score") >= F.lit(r.high_risk_score),
         F.when(F.col("risk_level") == F.lit("CRITICAL"), F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
         F.concat(F.lit("Shipment risk score reached "), score_txt, F.lit("."))),
        ("DOOR_OPEN", F.coalesce(F.col("door_open"), F.lit(0)) != F.lit(0), F.lit("MEDIUM"),
         F.lit("Cargo door opened during transit.")),
        ("LOW_BATTERY", F.col("battery_pct") < F.lit(r.low_battery_below), F.lit("LOW"),
         F.concat(F.lit("Sensor battery at "), F.col("battery_pct").cast("string"), F.lit("%."))),
    ]


def incident_structs(rules: Rules = DEFAULT_RULES) -> Column:
    """Array of 0..4 (incident_type, severity, description) structs per reading."""
    candidates = F.array(*[
        F.when(cond, F.struct(F.lit(t).alias("incident_type"), sev.alias("severity"), desc.alias("description")))
        for t, cond, sev, desc in incident_rules(rules)])
    return F.filter(candidates, lambda x: x.isNotNull())


def incident_count(rules: Rules = DEFAULT_RULES) -> Column:
    """Number of incidents a reading produces, without building their descriptions."""
    total = F.lit(0)
    for _, cond, _, _ in incident_rules(rules):
        total = total + F.when(cond, F.lit(1)).otherwise(F.lit(0))
    return total


def row_key(*cols: str | Column) -> Column:
    """Deterministic 256-bit hex key over the given parts (replaces random UUIDs)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)
