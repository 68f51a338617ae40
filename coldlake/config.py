"""Thresholds and vocabularies of the cold-chain and sales domains.

Everything here is configuration passed to operators as an argument
(``Rules``), never read as a hidden global inside a transformation.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the domain definitions for results to match.
# ---------------------------------------------------------------------------

# Safe temperature range (low, high) in degrees C per food category.
TEMP_RANGES: dict[str, tuple[float, float]] = {
    "Frozen Seafood": (-25.0, -12.0),
    "Ice Cream": (-30.0, -15.0),
    "Fresh Meat": (-2.0, 6.0),
    "Dairy": (0.0, 8.0),
    "Fresh Produce": (2.0, 12.0),
    "Beverages": (2.0, 10.0),
    "Baked Goods": (15.0, 25.0),
    "Poultry": (-2.0, 4.0),
    "Organic": (2.0, 10.0),
    "Ready-to-Eat": (2.0, 8.0),
    "Confectionery": (15.0, 25.0),
    "Snacks": (15.0, 25.0),
}
FOOD_CATEGORIES: list[str] = list(TEMP_RANGES)
DEFAULT_TEMP_RANGE: tuple[float, float] = (-30.0, 30.0)

WAREHOUSES: list[str] = [
    "North Hub", "Central Hub", "East Hub", "South Hub",
    "West Hub", "Airport Hub", "Port Hub", "Industrial Hub",
]
DESTINATIONS: list[str] = [
    "Retail District", "Restaurant District", "Airport", "Hospital Zone", "Market District",
    "Hotel District", "School Zone", "Office Park", "Residential Complex", "Sports Stadium",
]
DELIVERY_STATUSES: list[str] = [
    "IN_TRANSIT", "LOADING", "DELIVERED", "DELAYED", "CUSTOMS_HOLD", "RETURNED",
]
VEHICLE_TYPES: list[str] = ["Reefer Truck", "Refrigerated Van", "Cold Container Truck"]
REFRIGERATION_TYPES: list[str] = ["Mechanical", "Cryogenic", "Eutectic Plate"]

# Data-quality checks, in report order; one result row per check per run.
DQ_CHECKS: list[str] = [
    "null_shipment_id", "null_vehicle_id", "null_timestamp",
    "invalid_temperature", "invalid_humidity", "invalid_battery_pct",
    "invalid_speed", "invalid_coordinates", "duplicate_event_id",
]

TEMPERATURE_STATUSES: list[str] = ["SAFE", "WARNING", "CRITICAL"]
RISK_LEVELS: list[str] = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Sales map: region -> (lat, lon); anything else gets DEFAULT_GEO.
REGION_GEO: dict[str, tuple[float, float]] = {
    "West": (19.5, 73.0),
    "North": (29.0, 77.0),
    "South": (13.0, 78.0),
    "East": (22.5, 87.0),
}
DEFAULT_GEO: tuple[float, float] = (20.0, 78.0)

WEEKDAYS: list[str] = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Customer segments: right-closed revenue bins (lower, upper] and their labels.
SEGMENT_EDGES: list[float] = [0.0, 200.0, 500.0, 1000.0, float("inf")]
SEGMENT_LABELS: list[str] = ["Low", "Medium", "High", "VIP"]

FUNNEL_STAGES: list[str] = ["Total Order Lines", "Unique Orders", "Unique Customers", "Repeat Customers"]

OPEX_RATIO: float = 0.08
ORDER_RETENTION_HOURS: int = 720


@dataclass(frozen=True)
class Rules:
    """Numeric thresholds of the sensor pipeline and the reports."""

    # validation bounds, inclusive
    temp_min: float = -40.0
    temp_max: float = 40.0
    humidity_min: float = 0.0
    humidity_max: float = 100.0
    battery_min: float = 0.0
    battery_max: float = 100.0
    speed_min: float = 0.0
    speed_max: float = 160.0
    lat_abs_max: float = 90.0
    lon_abs_max: float = 180.0
    # temperature status: a breach further than this from the nearest bound is CRITICAL
    critical_breach: float = 5.0
    # risk points
    points_critical: int = 60
    points_warning: int = 30
    points_door: int = 15
    points_humidity: int = 10
    points_battery: int = 10
    points_speed: int = 5
    humidity_risk_above: float = 80.0
    battery_risk_below: float = 30.0
    speed_risk_above: float = 80.0
    score_cap: int = 100
    # risk level bands (score >= bound)
    level_critical: int = 80
    level_high: int = 60
    level_medium: int = 30
    # incidents
    high_risk_score: int = 60
    low_battery_below: float = 15.0
    # report bands
    health_healthy: float = 75.0
    health_watch: float = 50.0
    fresh_below_s: float = 10.0
    stale_from_s: float = 30.0
    exec_good: float = 70.0
    exec_fair: float = 50.0
    target_growth: float = 0.10
    kpi_growth_clamp: float = 200.0
    period_growth_clamp: float = 999.9


DEFAULT_RULES = Rules()


@dataclass(frozen=True)
class RunClock:
    """Deterministic processing clock for backfills: run k starts at start + k * cycle.

    Streaming runs use the trigger time instead (see ``streaming.sensor_stream``).
    """

    start: str = "2024-02-01 00:00:00"
    cycle_seconds: int = 20
