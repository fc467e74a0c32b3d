"""Operational reports over evidence: runs of quality checks, publication attempts, alerts, expectation events.

Each takes its evidence as frames and the present time as a value, so that it can be repeated. Limits are what these
reports are: the latest few of a log.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators import medallion
from quarrylake.operators.marts import two
from quarrylake.sources.landing import with_identity

#: Alerts with their severity, owner and the minutes within which they must show.
ALERTS = {
    "quality_error_check_failed": ("critical", "data_engineering", 30),
    "quality_evidence_stale": ("warning", "data_engineering", 60),
    "forecast_publication_failed": ("critical", "data_engineering", 30),
    "forecast_publication_stuck": ("warning", "data_engineering", 30),
    "invalid_ingestion_identity": ("critical", "data_engineering", 30),
    "deployment_or_runtime_identity_mismatch": ("critical", "platform", 5),
}
#: Hours after which evidence is stale, minutes after which a publication is stuck.
STALE_HOURS, STUCK_MINUTES = 24, 60
FORECAST_ORDER = ("validated_baseline", "accuracy_threshold_failed", "thresholds_not_configured")


def at(now: datetime) -> Column:
    return F.timestamp_micros(F.lit(int(now.timestamp() * 1_000_000)).cast("bigint"))


def age(unit: str, since: str, now: datetime) -> Column:
    """Complete units since a time."""
    return F.timestamp_diff(unit, F.col(since), at(now))


def rank_of(column: str, names: tuple[str, ...]) -> Column:
    """The place of a value among names, others last: for orders by meaning."""
    out = F.lit(len(names) + 1)
    for i, n in reversed(list(enumerate(names, 1))):
        out = F.when(F.col(column) == n, i).otherwise(out)
    return out


def latest(df: DataFrame, *order: str) -> DataFrame:
    """The one row with the greatest order columns, by one aggregation; none of an empty table."""
    one = df.agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return one.where("_r is not null").select("_r.*")


# evidence out of what was landed


def landing_checks(bronze: DataFrame) -> DataFrame:
    """quality_run_id, checked_at, check_name, status, severity, detail, observed_count: the checks of each day's arrivals, a run a day, at its end."""
    rows = medallion.typed(bronze)
    checks = {
        "required_keys_present": ("error", ~F.col("is_valid")),
        "durations_non_negative": ("error", (F.col("duration_minutes") < 0) | (F.col("downtime_minutes") < 0)),
        "fuel_level_in_range": ("warning", (F.col("fuel_level_pct") < 0) | (F.col("fuel_level_pct") > 100)),
        "hour_meter_present": ("warning", F.col("hour_meter").isNull()),
    }
    day = F.date_from_unix_date(F.floor(F.unix_seconds("_ingested_at") / 86_400).cast("int"))
    days = rows.where("_ingested_at is not null").groupBy(day.alias("day")).agg(*[F.count_if(F.coalesce(when, F.lit(False))).alias(n) for n, (_, when) in checks.items()])
    each = days.unpivot(["day"], list(checks), "check_name", "observed_count")
    severity = F.when(F.col("check_name").isin([n for n, (s, _) in checks.items() if s == "error"]), "error").otherwise("warning")
    bad = F.col("observed_count") > 0
    return each.select(
        F.concat(F.lit("landed-"), F.date_format("day", "yyyy-MM-dd")).alias("quality_run_id"),
        F.timestamp_seconds((F.unix_date("day") + 1) * F.lit(86_400)).alias("checked_at"),
        "check_name",
        F.when(bad, "fail").otherwise("pass").alias("status"),
        severity.alias("severity"),
        F.when(bad, "Landed records break the check").otherwise("All landed records pass").alias("detail"),
        "observed_count",
    )


def run_history(results: DataFrame) -> DataFrame:
    """The counts of each quality run."""
    failed = F.col("status") == "fail"
    runs = results.groupBy("quality_run_id", "checked_at").agg(
        F.count("*").alias("check_count"),
        F.count_if(~failed).alias("passed_check_count"),
        F.count_if(failed).alias("failed_check_count"),
        F.count_if(failed & (F.col("severity") == "error")).alias("failed_error_check_count"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("failed_warning_check_count"),
    )
    return runs.withColumn("all_error_checks_passed", F.col("failed_error_check_count") == 0)


def landing_manifest(bronze: DataFrame) -> DataFrame:
    """Each landing file as a publication attempt: failed where a key is missing in it, only started where a time doesn't read, else committed."""
    whole = lambda c: F.timestamp_seconds(F.unix_seconds(c))
    rows = medallion.typed(bronze)
    keys = medallion.blank(F.col("event_id")) | medallion.blank(F.col("machine_id")) | medallion.blank(F.col("site_id")) | medallion.blank(F.col("client_id"))
    files = rows.groupBy(F.col("_source_file").alias("forecast_run_id")).agg(
        F.min("_ingested_at").alias("_first"), F.max("_ingested_at").alias("_last"), F.count_if(keys).alias("_keys"), F.count_if(F.col("event_ts_utc").isNull()).alias("_times"),
        F.count("*").alias("forecast_row_count"), F.count_if("is_valid").alias("validation_row_count"),
    )
    state = F.when(F.col("_keys") > 0, "FAILED").when(F.col("_times") > 0, "STARTED").otherwise("COMMITTED")
    return files.select(
        "forecast_run_id",
        state.alias("publication_state"),
        whole("_first").alias("publication_started_at_utc"),
        F.when(state != "STARTED", whole("_last")).alias("publication_completed_at_utc"),
        "forecast_row_count",
        "validation_row_count",
        *[F.sha2(F.concat_ws("|", F.lit(c), "forecast_run_id"), 256).alias(c) for c in ("forecast_schema_sha256", "validation_schema_sha256", "forecast_payload_sha256", "validation_payload_sha256")],
    )


# reports


def latest_quality_run(history: DataFrame, now: datetime) -> DataFrame:
    """The latest quality run and its age in complete hours."""
    return latest(history, "checked_at", "quality_run_id").withColumn("evidence_age_hours", age("HOUR", "checked_at", now))


def quality_monitoring(history: DataFrame, results: DataFrame) -> DataFrame:
    """The latest run with its failed checks, errors first; one row without a check if none failed."""
    run = latest(history, "checked_at", "quality_run_id").select("quality_run_id", "checked_at", "failed_error_check_count", "failed_warning_check_count", "all_error_checks_passed")
    failed = results.where("status = 'fail'").select(F.col("quality_run_id").alias("_run"), "severity", "check_name", "status", "detail", "observed_count")
    joined = run.join(failed, run["quality_run_id"] == failed["_run"], "left").drop("_run")
    return joined.orderBy(rank_of("severity", ("error", "warning")), "check_name")


def quality_run_history(history: DataFrame, n: int = 30) -> DataFrame:
    """The latest n quality runs."""
    return history.orderBy(F.desc("checked_at"), F.desc("quality_run_id")).limit(n)


def publication_attempts(manifest: DataFrame, now: datetime, n: int = 100) -> DataFrame:
    """The latest n attempts, whether each is the commit that shows, and how long one that only started has been so."""
    committed = manifest.where("publication_state = 'COMMITTED' and publication_completed_at_utc is not null")
    current = latest(committed.select("forecast_run_id", "publication_completed_at_utc"), "publication_completed_at_utc", "forecast_run_id").select(F.col("forecast_run_id").alias("_run"))
    started = F.col("publication_state") == "STARTED"
    joined = manifest.join(F.broadcast(current), manifest["forecast_run_id"] == F.col("_run"), "left")  # one row
    return (
        joined.select(
            "forecast_run_id", "publication_state", "publication_started_at_utc", "publication_completed_at_utc", "forecast_row_count", "validation_row_count", "forecast_payload_sha256",
            "validation_payload_sha256", F.col("_run").isNotNull().alias("is_current_committed_run"), F.when(started, age("MINUTE", "publication_started_at_utc", now)).alias("started_age_minutes"),
        )
        .orderBy(F.desc("publication_started_at_utc"), F.desc("forecast_run_id"))
        .limit(n)
    )


def recent_publications(manifest: DataFrame, n: int = 30) -> DataFrame:
    """The latest n attempts with their evidence."""
    return manifest.orderBy(F.desc("publication_started_at_utc"), F.desc("forecast_run_id")).limit(n)


def alert_candidates(history: DataFrame, manifest: DataFrame, bronze: DataFrame, now: datetime) -> DataFrame:
    """alert_id, severity, owner_role, evidence_id, observed_at, observed_count of what calls for attention now.

    Failed error checks or stale evidence of the latest quality run, a latest publication that failed or is stuck, and
    records whose file has no valid identity. At most one row each.
    """
    run = latest(history, "checked_at", "quality_run_id")
    attempt = latest(manifest.select("forecast_run_id", "publication_state", "publication_started_at_utc"), "publication_started_at_utc", "forecast_run_id")
    identity = with_identity(bronze).agg(F.count_if(~F.col("_source_identity_valid")).alias("n"))

    def alert(df: DataFrame, name: str, when: Column, evidence: Column, seen: Column, n: Column) -> DataFrame:
        severity, owner, _ = ALERTS[name]
        return df.where(when).select(
            F.lit(name).alias("alert_id"), F.lit(severity).alias("severity"), F.lit(owner).alias("owner_role"), evidence.cast("string").alias("evidence_id"), seen.alias("observed_at"), n.cast("bigint").alias("observed_count")
        )

    q, f, checked, began = F.col("quality_run_id"), F.col("forecast_run_id"), F.col("checked_at"), F.col("publication_started_at_utc")
    hours, minutes, errors, state = age("HOUR", "checked_at", now), age("MINUTE", "publication_started_at_utc", now), F.col("failed_error_check_count"), F.col("publication_state")
    parts = [
        alert(run, "quality_error_check_failed", errors > 0, q, checked, errors),
        alert(run, "quality_evidence_stale", hours >= STALE_HOURS, q, checked, hours),
        alert(attempt, "forecast_publication_failed", state == "FAILED", f, began, F.lit(1)),
        alert(attempt, "forecast_publication_stuck", (state == "STARTED") & (minutes > STUCK_MINUTES), f, began, minutes),
        alert(identity, "invalid_ingestion_identity", F.col("n") > 0, F.lit("bronze_machine_events"), at(now), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("severity", "alert_id").limit(100)


def downtime_forecast(forecast: DataFrame) -> DataFrame:
    """The forecast, the readiest and then the largest first."""
    columns = (
        "forecast_run_id", "forecast_generated_at", "forecast_date", "latest_actual_date", "site_id", "client_id", "model", "window_semantics", "baseline_window_days", "forecast_horizon_days",
        "machine_count", "forecast_downtime_minutes", "prediction_interval_lower_minutes", "prediction_interval_upper_minutes", "validation_observation_count", "mae_downtime_minutes",
        "rmse_downtime_minutes", "backtest_interval_coverage_pct", "thresholds_configured", "max_mae_downtime_minutes", "min_interval_coverage_pct", "meets_min_validation_samples",
        "meets_mae_threshold", "meets_interval_coverage_threshold", "forecast_status",
    )
    return forecast.select(*columns).orderBy(rank_of("forecast_status", FORECAST_ORDER), F.desc("forecast_downtime_minutes"), "site_id", "client_id", "model")


def forecast_backtest(validated: DataFrame) -> DataFrame:
    """Errors and coverage of each segment's backtest, the worst first."""
    keys = ("forecast_run_id", "validation_generated_at", "site_id", "client_id", "model", "window_semantics", "baseline_window_days")
    return (
        validated.groupBy(*keys)
        .agg(
            F.count("*").alias("validation_observation_count"),
            two(F.avg("absolute_error_minutes")).alias("mae_downtime_minutes"),
            two(F.sqrt(F.avg("squared_error_minutes"))).alias("rmse_downtime_minutes"),
            two(F.avg("absolute_percentage_error") * 100).alias("mape_pct"),
            two(F.avg(F.when(F.col("covered_by_validation_interval"), 1.0).otherwise(0.0)) * 100).alias("backtest_interval_coverage_pct"),
            F.max("event_date").alias("latest_validation_date"),
        )
        .orderBy(F.desc("mae_downtime_minutes"), "site_id", "client_id", "model")
    )


def expectation_events(results: DataFrame, when: datetime, n: int = 50) -> DataFrame:
    """The latest n events of an expectation run: one per expectation with its counts, and one for the run."""
    bad = F.col("failed_records") > 0
    flows = results.select(
        F.lit("flow_progress").alias("event_type"),
        F.when(bad, "WARN").otherwise("INFO").alias("level"),
        F.concat(F.col("dataset"), F.lit(": "), F.col("expectation")).alias("message"),
        F.to_json(F.struct("passed_records", "failed_records")).alias("details"),
    )
    run = results.agg(
        F.lit("update_progress").alias("event_type"), F.lit("INFO").alias("level"), F.lit("COMPLETED").alias("message"), F.to_json(F.struct(F.count("*").alias("expectations"))).alias("details")
    )
    return flows.unionByName(run).withColumn("timestamp", at(when)).orderBy(F.desc("timestamp"), F.desc("event_type"), "message").limit(n)


def expectation_row_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """expectation_dataset and row_count of each dataset that has expectations."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(f"quality_expectation_{n}").alias("expectation_dataset"), "row_count") for n, df in sorted(datasets.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("expectation_dataset")
