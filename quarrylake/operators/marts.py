"""Marts over trusted events: each is a grain and a set of measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the version of the rule that relates downtime to observation.
SEMANTICS = "attributed_incident_v1"
DAILY = ("event_date", "site_id", "client_id", "machine_id", "model")
STATUS_MINUTES = {"RUNNING": "running_minutes", "IDLE": "idle_minutes", "MAINTENANCE": "maintenance_minutes"}
FAILURE_COLUMNS = (
    "event_id", "event_date", "event_ts_utc", "site_id", "client_id", "machine_id", "model", "fault_code", "severity",
    "temperature_c", "vibration_mm_s", "downtime_minutes", "maintenance_cost_gbp", "part_code", "part_quantity",
)


def two(x: Column) -> Column:
    """x rounded to two places, halves away from zero, as a double.

    Rounded as a decimal of ten places, which sums and averages in binary are exact to whatever the order of their terms.
    What a decimal can't hold has no places to round.
    """
    return F.coalesce(F.round(x.try_cast("decimal(38,10)"), 2).cast("double"), x.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part in percent of whole to two places; NULL unless whole is positive."""
    return F.when(whole > 0, two(part / whole * 100))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, two(part / whole))


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def downtime_load() -> Column:
    """Downtime in percent of observation. It may exceed 100; it is NULL where downtime was recorded without observation."""
    down, seen = F.col("downtime_minutes"), F.col("observed_minutes")
    return F.when(seen > 0, two(down / seen * 100)).when(down == 0, F.lit(0.0))


def with_downtime_semantics(df: DataFrame) -> DataFrame:
    """How downtime_minutes relates to observed_minutes."""
    return df.withColumns(
        {
            "downtime_load_pct": downtime_load(),
            "downtime_pct": downtime_load(),
            "downtime_exceeds_observed": F.col("downtime_minutes") > F.col("observed_minutes"),
            "downtime_semantics_version": F.lit(SEMANTICS),
        }
    )


#: The columns of trusted events from which all marts are made.
SOURCE = (
    "event_id", "event_date", "event_ts_utc", "site_id", "client_id", "machine_id", "model", "status", "fault_code", "severity", "temperature_c", "vibration_mm_s", "fuel_level_pct",
    "duration_minutes", "downtime_minutes", "maintenance_cost_gbp", "part_code", "part_quantity",
)
#: What a machine's day has of its failures, beside the uptime mart.
OF_FAILURES = ("failure_event_count", "failure_downtime_minutes", "failure_cost_gbp", "latest_failure_at_utc")


def machine_days(silver: DataFrame) -> DataFrame:
    """Minutes by status, downtime, observation, health and uptime of each machine's day, and what of it are failures.

    A status' minutes are NULL where all its durations are. Reports on both days and failures read this one aggregation.
    """
    in_status = lambda s: F.sum(F.when(F.col("status") == s, F.col("duration_minutes")).otherwise(0))
    failed = F.col("is_failure_event")
    daily = silver.groupBy(*DAILY).agg(
        *[in_status(s).alias(name) for s, name in STATUS_MINUTES.items()],
        F.sum(F.coalesce("downtime_minutes", F.lit(0))).alias("downtime_minutes"),
        F.sum(F.coalesce("duration_minutes", F.lit(0))).alias("observed_minutes"),
        F.avg("health_score").alias("avg_health_score"),
        F.count_if(failed).alias("failure_event_count"),
        F.sum(F.when(failed, F.coalesce("downtime_minutes", F.lit(0))).otherwise(0)).alias("failure_downtime_minutes"),
        F.sum(F.when(failed, F.col("maintenance_cost_gbp")).otherwise(0.0)).alias("failure_cost_gbp"),
        F.max(F.when(failed, F.col("event_ts_utc"))).alias("latest_failure_at_utc"),
    )
    return with_downtime_semantics(daily.withColumn("uptime_pct", share(F.col("running_minutes"), F.col("observed_minutes"))))


def machine_uptime(silver: DataFrame) -> DataFrame:
    """machine_days without failures."""
    return machine_days(silver).drop(*OF_FAILURES)


def failure_events(silver: DataFrame) -> DataFrame:
    return silver.where("is_failure_event").select(*FAILURE_COLUMNS)


def maintenance_costs(silver: DataFrame) -> DataFrame:
    """Events, cost and downtime by month, site, client and model."""
    return silver.groupBy(month_of(F.col("event_date")).alias("event_month"), "site_id", "client_id", "model").agg(
        F.count_if(F.col("status") == "MAINTENANCE").alias("maintenance_event_count"),
        F.count_if("is_failure_event").alias("failure_event_count"),
        two(F.sum("maintenance_cost_gbp")).alias("maintenance_cost_gbp"),
        F.sum("downtime_minutes").alias("downtime_minutes"),
    )


def used_parts(events: DataFrame) -> DataFrame:
    return events.where((F.upper(F.trim("part_code")) != "NONE") & (F.col("part_quantity") > 0))


def parts_usage(silver: DataFrame) -> DataFrame:
    """Quantity, cost and machines of each part by day, site, client and model."""
    return used_parts(silver).groupBy("event_date", "site_id", "client_id", "model", "part_code").agg(
        F.sum("part_quantity").alias("part_quantity"),
        two(F.sum("maintenance_cost_gbp")).alias("associated_cost_gbp"),
        F.count_distinct("machine_id").alias("machine_count"),
    )


def asset_summary(days: DataFrame) -> DataFrame:
    """Each machine at a client's site, out of machine_days. Failures are those of the machine there under any model, so two models repeat them."""
    place = ("client_id", "site_id", "machine_id")
    models = days.groupBy(*place, "model").agg(
        two(F.avg("uptime_pct")).alias("avg_uptime_pct"),
        two(F.avg("avg_health_score")).alias("avg_health_score"),
        F.sum("downtime_minutes").alias("total_downtime_minutes"),
        F.sum("failure_event_count").alias("n"),
        F.sum("failure_cost_gbp").alias("cost"),
    )
    under_any = W.partitionBy(*place)  # a row per model
    both = {"failure_event_count": F.sum("n").over(under_any), "failure_related_cost_gbp": two(F.sum("cost").over(under_any))}
    return models.withColumns(both).drop("n", "cost")
