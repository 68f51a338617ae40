"""Operations reports from the merged partial aggregates of an epoch store (C1-C35 in the refresh loop).

Each equals its counterpart in ``ops_reports`` over the published readings; final formulas are
shared with it. A reading costs the cells of the grain, whatever the history's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.config import DEFAULT_RULES, Rules
from coldlake.functions.numeric import half_even, pct
from coldlake.functions.periods import hour_label, minute_label
from coldlake.operators import ops_reports as R
from coldlake.operators.common import attach_scalars, stat
from coldlake.sources.epochs import EpochStore


class LiveReports:
    """The reports of one published head: all of them show the same epochs."""

    def __init__(self, store: EpochStore, rules: Rules = DEFAULT_RULES):
        self.store, self.rules, self.head = store, rules, store.log.head()

    def _grain(self, name: str) -> DataFrame:
        return self.store.partial(name, self.head)

    def _cells(self, *keys: str) -> DataFrame:
        """The cells at coarser keys, with every measure the readings reports use."""
        safe = F.when(F.col("temperature_status") == "SAFE", F.col("n")).otherwise(F.lit(0))
        risky = F.col("risk_level").isin("HIGH", "CRITICAL").cast("int")
        return self._grain("cell").groupBy(*keys).agg(
            F.sum("n").alias("n"), F.sum(safe).alias("safe_n"), F.max(risky).alias("any_risk"),
            *[F.sum(c).alias(c) for c in ("risk_sum", "battery_sum", "humidity_sum", "temperature_sum", "closed_n", "anomaly_n", "low_battery_n")])

    def top_kpis(self) -> DataFrame:
        """C1."""
        return R.top_kpis_of(self._cells("shipment_id", "vehicle_id"))

    def quality_score(self) -> DataFrame:
        """The latest run's score: every check keeps its newest run, and every run has every check."""
        latest = self._grain("check").agg(F.sum("latest.records_checked").alias("checked"), F.sum("latest.failures").alias("failed"))
        return latest.select(R.quality_score_of("checked", "failed").alias("data_quality_score"))

    def second_kpis(self) -> DataFrame:
        """C2."""
        high = F.sum(F.when(F.col("severity") == "HIGH", F.col("n")))
        rest = F.sum(F.when(F.col("severity").isin("MEDIUM", "LOW"), F.col("n")))
        inc = self._grain("incident").agg(F.coalesce(high, F.lit(0)).alias("critical_incidents"), F.coalesce(rest, F.lit(0)).alias("warning_incidents"))
        low = F.count_if(F.col("low_battery_n") > 0)
        cond = self._cells("vehicle_id").agg(
            F.coalesce(half_even(F.try_divide(F.sum("temperature_sum"), F.sum("n")), 2), F.lit(0.0)).alias("avg_temperature"),
            F.coalesce(half_even(F.try_divide(F.sum("humidity_sum"), F.sum("n")), 1), F.lit(0.0)).alias("avg_humidity"), low.alias("low_battery_vehicles"))
        return attach_scalars(inc, cond, self.quality_score())

    def compliance_distribution(self) -> DataFrame:
        """C7a."""
        return self._grain("cell").groupBy(F.col("temperature_status").alias("status")).agg(F.sum("n").alias("count"))

    def risk_distribution(self) -> DataFrame:
        """C7b."""
        return self._grain("cell").groupBy("risk_level").agg(F.count_distinct("shipment_id").alias("count"))

    def risk_by_warehouse(self, dim_shipment: DataFrame) -> DataFrame:
        """C8."""
        return R.risk_by_dim_of(self._cells("shipment_id"), dim_shipment, "warehouse")

    def risk_by_food_category(self, dim_shipment: DataFrame) -> DataFrame:
        """C9."""
        return R.risk_by_dim_of(self._cells("shipment_id"), dim_shipment, "food_category")

    def vehicle_health(self) -> DataFrame:
        """C10."""
        return self._cells("vehicle_id").select(
            "vehicle_id", stat(F.try_divide("risk_sum", "n")).alias("avg_risk"), stat(F.try_divide("battery_sum", "n")).alias("avg_battery"),
            stat(pct("safe_n", "n")).alias("compliance_pct")).orderBy(F.col("avg_risk").desc(), "vehicle_id")

    def latest_vehicle_locations(self) -> DataFrame:
        """C11."""
        return self._grain("latest").select("vehicle_id", "r.latitude", "r.longitude", "r.temperature_c", "r.risk_level", "r.event_timestamp")

    def shipment_health(self) -> DataFrame:
        """C12."""
        per = self._cells("shipment_id").select(
            "shipment_id", F.try_divide("risk_sum", "n").alias("avg_risk"), pct("safe_n", "n").alias("temp_compliance"),
            F.try_divide("battery_sum", "n").alias("avg_battery"), pct("closed_n", "n").alias("door_discipline"))
        return R.shipment_health_of(per, self.rules)

    def incident_severity_counts(self) -> DataFrame:
        """C14."""
        return self._grain("incident").groupBy("severity").agg(F.sum("n").alias("count"))

    def incident_type_counts(self) -> DataFrame:
        """C15."""
        return self._grain("incident").groupBy("incident_type").agg(F.sum("n").alias("count")).orderBy(F.col("count").desc(), "incident_type")

    def pipeline_health(self) -> DataFrame:
        """C16."""
        totals = self._grain("run").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(o) for c, o in (
            ("rows_generated", "records_generated"), ("rows_processed", "records_processed"), ("rows_rejected", "records_rejected"), ("n", "total_runs"))],
            F.max("latest").alias("latest"))
        return R.pipeline_health_of(totals)

    def data_quality_summary(self) -> DataFrame:
        """C18a."""
        return self._grain("check").select("check_name", "records_checked", "failures", F.when(F.col("failures") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"))

    def rejection_reasons(self) -> DataFrame:
        """C18b."""
        return self._grain("reject").select("rejection_reason", F.col("n").alias("count")).orderBy(F.col("count").desc(), "rejection_reason")

    def data_freshness_seconds(self, now: Column) -> DataFrame:
        """C20."""
        return R.data_freshness_seconds(self._grain("latest").select("r.event_timestamp"), now)

    def anomaly_rate(self) -> DataFrame:
        """C22."""
        return self._grain("cell").agg(F.coalesce(half_even(pct(F.sum("anomaly_n"), F.sum("n")), 1), F.lit(0.0)).alias("anomaly_rate"))

    def status_over_time(self) -> DataFrame:
        """C26."""
        return self._grain("minute").select(minute_label("minute_start").alias("minute"), "temperature_status", F.col("n").alias("count")).orderBy("minute", "temperature_status")

    def door_open_trend(self) -> DataFrame:
        """C27."""
        return (self._grain("minute").groupBy(minute_label("minute_start").alias("minute"))
                .agg(F.sum("door_opens").alias("door_opens"), F.sum("n").alias("total")).orderBy("minute"))

    def hourly_reading_counts(self) -> DataFrame:
        """C28."""
        return self._grain("minute").groupBy(hour_label("minute_start").alias("hour")).agg(F.sum("n").alias("count")).orderBy("hour")

    def food_category_compliance(self, dim_shipment: DataFrame) -> DataFrame:
        """C32."""
        return R.food_category_compliance_of(self._cells("shipment_id").withColumnRenamed("humidity_sum", "hum_sum"), dim_shipment)

    def sensor_correlation_matrix(self) -> DataFrame:
        """C34."""
        g = self.store.grains["moments"]
        sums = self._grain("moments").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in g.sums],
                                          *[(F.max(f"hi_{c}") > F.min(f"lo_{c}")).alias(f"varies_{c}") for c in R.CORR_COLUMNS])
        return R.correlation_of(sums, R.CORR_COLUMNS)

    def system_health_score(self) -> DataFrame:
        """C35."""
        return R.system_health_of(self.shipment_health(), self.top_kpis(), self.quality_score())
