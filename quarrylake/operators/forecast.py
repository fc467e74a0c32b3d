"""Downtime forecast: the mean of the observed days in a trailing calendar window, with a backtest of every past day.

Windows count calendar days, so that neither missing days nor clock changes alter them. Everything about a segment comes
from windows over one partitioning by segment; nothing is joined back to itself.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.marts import two

SEGMENT = ("site_id", "client_id", "model")
#: What forecasts call themselves and how ready they are.
MODEL, SEMANTICS = "calendar_rolling_mean", "prior_calendar_days"
STATUSES = ("insufficient_validation_history", "thresholds_not_configured", "validated_baseline", "accuracy_threshold_failed")


@dataclass(frozen=True)
class Config:
    window_days: int
    horizon_days: int
    min_observations: int
    max_mae: float | None = None
    min_coverage: float | None = None

    def __post_init__(self) -> None:
        for n in ("window_days", "horizon_days", "min_observations"):
            v = getattr(self, n)
            if type(v) is not int or v < 1:
                raise ValueError(f"{n} must be a whole number of at least 1")
        if (self.max_mae is None) != (self.min_coverage is None):
            raise ValueError("max_mae and min_coverage belong together")
        if self.max_mae is not None:
            if isinstance(self.max_mae, bool) or not (math.isfinite(self.max_mae) and self.max_mae >= 0):
                raise ValueError("max_mae must be finite and not negative")
            if isinstance(self.min_coverage, bool) or not (math.isfinite(self.min_coverage) and 0 <= self.min_coverage <= 100):
                raise ValueError("min_coverage must be from 0 to 100")


def check_run(run_id: str, generated_at: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9._:-]{1,128}", run_id):
        raise ValueError("run_id must have 1 to 128 letters, digits, dots, dashes, colons or underscores")
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", generated_at):
        raise ValueError("generated_at must look like 2026-01-31T12:00:00Z")


def daily_actuals(uptime: DataFrame) -> DataFrame:
    """Downtime, machines, uptime and health of each segment's observed days."""
    return uptime.where("event_date is not null").groupBy("event_date", *SEGMENT).agg(
        F.sum(F.coalesce("downtime_minutes", F.lit(0))).alias("actual_downtime_minutes"),
        F.count_distinct("machine_id").alias("machine_count"),
        two(F.avg("uptime_pct")).alias("avg_uptime_pct"),
        two(F.avg("avg_health_score")).alias("avg_health_score"),
    )


def _known() -> Column:
    known = F.lit(True)
    for c in SEGMENT:
        known = known & F.col(c).isNotNull()
    return known


def _scored(daily: DataFrame, config: Config) -> DataFrame:
    """daily with each day's forecast from the observed days before it within the window, and its errors and interval; NULL on days without history.

    Everything comes from windows over one partitioning by segment. Segments with a missing key have errors, but no padding.
    """
    past = W.partitionBy(*SEGMENT).orderBy(F.unix_date("event_date")).rangeBetween(-config.window_days, -1)
    whole = W.partitionBy(*SEGMENT)
    actual, guess = F.col("actual_downtime_minutes"), F.col("forecast_downtime_minutes")
    rows = daily.select(
        "*",
        two(F.avg("actual_downtime_minutes").over(past)).alias("forecast_downtime_minutes"),
        F.count("actual_downtime_minutes").over(past).alias("history_day_count"),
        F.min("event_date").over(past).alias("history_start_date"),
        F.max("event_date").over(whole).alias("latest_actual_date"),
    )
    rows = rows.withColumns(
        {
            "history_calendar_span_days": F.datediff("event_date", "history_start_date"),
            "absolute_error_minutes": two(F.abs(actual - guess)),
            "squared_error_minutes": (actual - guess) * (actual - guess),
            "absolute_percentage_error": F.when(actual > 0, F.abs(actual - guess) / actual),
            "residual_minutes": two(actual - guess),
        }
    )
    deviation, mae = two(F.stddev_samp("residual_minutes").over(whole)), two(F.avg("absolute_error_minutes").over(whole))
    rows = rows.withColumn("_pad", F.when(_known(), F.coalesce(deviation, mae)).otherwise(F.lit(0.0)))
    rows = rows.withColumns(
        {
            "validation_interval_lower_minutes": F.when(guess.isNotNull(), F.greatest(F.lit(0.0), two(guess - F.col("_pad")))),
            "validation_interval_upper_minutes": two(guess + F.col("_pad")),
        }
    )
    covered = actual.between(F.col("validation_interval_lower_minutes"), F.col("validation_interval_upper_minutes"))
    return rows.withColumn("covered_by_validation_interval", covered).drop("_pad")


def validation(daily: DataFrame, config: Config, run_id: str, generated_at: str) -> DataFrame:
    """One row per segment and day that has an earlier observed day within the window: forecast, errors and interval.

    Segments with a missing key have errors, but no interval padding.
    """
    check_run(run_id, generated_at)
    rows = _scored(daily, config).where("history_day_count > 0").drop("avg_uptime_pct", "avg_health_score", "latest_actual_date")
    return rows.withColumns(
        {
            "forecast_run_id": F.lit(run_id),
            "validation_generated_at": F.lit(generated_at).cast("timestamp"),
            "model_name": F.lit(MODEL),
            "window_semantics": F.lit(SEMANTICS),
            "baseline_window_days": F.lit(config.window_days),
        }
    )


def _metrics() -> list[Column]:
    """Errors and interval coverage of a segment's backtest, over its days with history: on the others all of these are NULL."""
    return [
        F.count_if(F.col("history_day_count") > 0).alias("validation_observation_count"),
        two(F.avg("absolute_error_minutes")).alias("mae_downtime_minutes"),
        two(F.sqrt(F.avg("squared_error_minutes"))).alias("rmse_downtime_minutes"),
        two(F.avg("absolute_percentage_error") * 100).alias("mape_pct"),
        two(F.stddev_samp("residual_minutes")).alias("residual_stddev_minutes"),
        F.max(F.when(F.col("history_day_count") > 0, F.col("event_date"))).alias("latest_validation_date"),
        two(F.avg(F.when(F.col("history_day_count") > 0, F.col("covered_by_validation_interval").cast("double"))) * 100).alias("backtest_interval_coverage_pct"),
    ]


def metrics(validated: DataFrame) -> DataFrame:
    """Errors and interval coverage of each segment's backtest."""
    return validated.groupBy(*SEGMENT).agg(*_metrics())


def forecast(daily: DataFrame, config: Config, run_id: str, generated_at: str) -> DataFrame:
    """One row per segment with all keys: the forecast horizon_days after its latest observed day, its interval, and how ready it is.

    Recent days and the backtest of all days are aggregated from one pass.
    """
    check_run(run_id, generated_at)
    recent = F.col("event_date") > F.date_sub("latest_actual_date", config.window_days)
    late = lambda c: F.when(recent, F.col(c))
    rows = _scored(daily.where(_known()), config).groupBy(*SEGMENT, "latest_actual_date").agg(
        F.min(late("event_date")).alias("forecast_history_start_date"),
        F.count_if(recent).alias("forecast_history_day_count"),
        two(F.avg(late("actual_downtime_minutes"))).alias("forecast_downtime_minutes"),
        two(F.avg(late("avg_uptime_pct"))).alias("recent_avg_uptime_pct"),
        two(F.avg(late("avg_health_score"))).alias("recent_avg_health_score"),
        F.max(late("machine_count")).alias("machine_count"),
        *_metrics(),
    )
    set_up = config.max_mae is not None
    limit, floor = F.lit(config.max_mae).cast("double"), F.lit(config.min_coverage).cast("double")
    met = lambda when: F.coalesce(when, F.lit(False)) if set_up else F.lit(False)
    enough = F.col("validation_observation_count") >= config.min_observations
    accurate, covered = met(F.col("mae_downtime_minutes") <= limit), met(F.col("backtest_interval_coverage_pct") >= floor)
    pad = F.coalesce("residual_stddev_minutes", "mae_downtime_minutes", F.lit(0.0))
    guess = F.col("forecast_downtime_minutes")
    return rows.select(
        F.lit(run_id).alias("forecast_run_id"),
        F.lit(generated_at).cast("timestamp").alias("forecast_generated_at"),
        F.date_add("latest_actual_date", config.horizon_days).alias("forecast_date"),
        "latest_actual_date",
        F.lit(MODEL).alias("model_name"),
        F.lit(SEMANTICS).alias("window_semantics"),
        F.lit(config.window_days).alias("baseline_window_days"),
        F.lit(config.horizon_days).alias("forecast_horizon_days"),
        F.lit(config.min_observations).alias("min_validation_observations"),
        *SEGMENT,
        "machine_count",
        guess,
        F.greatest(F.lit(0.0), two(guess - pad)).alias("prediction_interval_lower_minutes"),
        two(guess + pad).alias("prediction_interval_upper_minutes"),
        "recent_avg_uptime_pct",
        "recent_avg_health_score",
        "forecast_history_day_count",
        "forecast_history_start_date",
        (F.datediff("latest_actual_date", "forecast_history_start_date") + 1).alias("forecast_history_calendar_span_days"),
        "validation_observation_count",
        "mae_downtime_minutes",
        "rmse_downtime_minutes",
        "mape_pct",
        "backtest_interval_coverage_pct",
        "latest_validation_date",
        F.lit(set_up).alias("thresholds_configured"),
        limit.alias("max_mae_downtime_minutes"),
        floor.alias("min_interval_coverage_pct"),
        enough.alias("meets_min_validation_samples"),
        accurate.alias("meets_mae_threshold"),
        covered.alias("meets_interval_coverage_threshold"),
        F.when(~enough, STATUSES[0]).when(F.lit(not set_up), STATUSES[1]).when(accurate & covered, STATUSES[2]).otherwise(STATUSES[3]).alias("forecast_status"),
    )


def diagnostics(validated: DataFrame) -> DataFrame:
    """Each segment's backtest errors, their bias, and the day of the largest."""
    run = ("forecast_run_id", "model_name", "window_semantics", "baseline_window_days", "client_id", "site_id", "model")
    largest = {
        "largest_absolute_error_date": "event_date",
        "largest_error_machine_count": "machine_count",
        "largest_error_actual_downtime_minutes": "actual_downtime_minutes",
        "largest_error_forecast_downtime_minutes": "forecast_downtime_minutes",
        "largest_absolute_error_minutes": "absolute_error_minutes",
        "largest_error_residual_minutes": "residual_minutes",
        "largest_error_history_day_count": "history_day_count",
        "largest_error_history_start_date": "history_start_date",
        "largest_error_history_calendar_span_days": "history_calendar_span_days",
        "largest_error_interval_lower_minutes": "validation_interval_lower_minutes",
        "largest_error_interval_upper_minutes": "validation_interval_upper_minutes",
        "largest_error_covered_by_interval": "covered_by_validation_interval",
    }
    residual = F.col("residual_minutes")
    rows = validated.groupBy(*run).agg(
        F.max("validation_generated_at").alias("validation_generated_at"),
        F.count("*").alias("validation_observation_count"),
        F.min("event_date").alias("first_validation_date"),
        F.max("event_date").alias("latest_validation_date"),
        two(F.avg("actual_downtime_minutes")).alias("avg_actual_downtime_minutes"),
        two(F.avg("forecast_downtime_minutes")).alias("avg_forecast_downtime_minutes"),
        two(F.avg(residual)).alias("mean_error_minutes"),
        two(F.avg("absolute_error_minutes")).alias("mae_downtime_minutes"),
        two(F.sqrt(F.avg("squared_error_minutes"))).alias("rmse_downtime_minutes"),
        F.count("absolute_percentage_error").alias("percentage_error_observation_count"),
        two(F.avg("absolute_percentage_error") * 100).alias("mape_pct"),
        two(F.avg(F.when(F.col("covered_by_validation_interval"), 1.0).otherwise(0.0)) * 100).alias("validation_interval_coverage_pct"),
        F.count_if(residual > 0).alias("under_forecast_observation_count"),
        F.count_if(residual < 0).alias("over_forecast_observation_count"),
        F.count_if(residual == 0).alias("exact_forecast_observation_count"),
        F.max_by(F.struct(*largest.values()), F.struct("absolute_error_minutes", "event_date")).alias("_worst"),
    )
    bias = (
        F.when(F.col("mae_downtime_minutes") == 0, "exact_validation_observations")
        .when(F.col("mean_error_minutes") > 0, "under_forecast_bias_observed")
        .when(F.col("mean_error_minutes") < 0, "over_forecast_bias_observed")
        .otherwise("balanced_mean_error")
    )
    return rows.select("*", bias.alias("validation_bias_status"), *[F.col(f"_worst.{c}").alias(n) for n, c in largest.items()]).drop("_worst")
