"""Checks as data: named predicates and grains, all evaluated in one pass over a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.marts import SEMANTICS

_MINUTES = ("running_minutes", "idle_minutes", "maintenance_minutes", "downtime_minutes", "observed_minutes")


def _present(*columns: str) -> str:
    return " AND ".join(f"trim(cast({c} AS string)) <> ''" for c in columns)


def _within(c: str, lo: float = 0, hi: float | None = None) -> str:
    return f"({c} IS NULL OR {c} >= {lo}" + (f" AND {c} <= {hi})" if hi is not None else ")")


def _each(pattern: str, columns: tuple[str, ...]) -> str:
    return " AND ".join(pattern.format(c) for c in columns)


STATUS_WITHIN = "coalesce(running_minutes, 0) + coalesce(idle_minutes, 0) + coalesce(maintenance_minutes, 0) <= coalesce(observed_minutes, 0)"
LOAD_VALID = (
    "CASE WHEN observed_minutes > 0 THEN abs(downtime_load_pct - downtime_minutes / observed_minutes * 100) <= 0.0151 "
    "WHEN observed_minutes = 0 AND downtime_minutes = 0 THEN downtime_load_pct = 0 "
    "WHEN observed_minutes = 0 AND downtime_minutes > 0 THEN downtime_load_pct IS NULL END"
)
EXCEEDS_VALID = "downtime_exceeds_observed <=> (downtime_minutes > observed_minutes)"
VERSION_KNOWN = f"downtime_semantics_version = '{SEMANTICS}'"

#: What rows of each table are expected to fulfil. A row for which a predicate isn't true fails it; no row is dropped.
EXPECTATIONS: dict[str, dict[str, str]] = {
    "silver": {
        **{f"{c}_present": _present(c) for c in ("event_id", "machine_id", "site_id", "client_id")},
        "event_timestamp_present": "event_ts_utc IS NOT NULL",
        "duration_non_negative": _within("duration_minutes"),
        "downtime_non_negative": _within("downtime_minutes"),
        "maintenance_cost_non_negative": _within("maintenance_cost_gbp"),
        "fuel_level_in_range": _within("fuel_level_pct", 0, 100),
        "health_score_in_range": _within("health_score", 0, 100),
    },
    "uptime": {
        "event_date_present": "event_date IS NOT NULL",
        **{f"{c}_present": _present(c) for c in ("machine_id", "site_id")},
        "duration_values_present": _each("{} IS NOT NULL", _MINUTES),
        "duration_values_non_negative": _each("{} >= 0", _MINUTES),
        "status_minutes_within_observed": STATUS_WITHIN,
        "uptime_pct_in_range": _within("uptime_pct", 0, 100),
        "avg_health_score_in_range": _within("avg_health_score", 0, 100),
        "downtime_load_formula_valid": LOAD_VALID,
        "downtime_compatibility_alias_consistent": "downtime_pct <=> downtime_load_pct",
        "downtime_exceedance_flag_consistent": EXCEEDS_VALID,
        "downtime_semantics_version_known": VERSION_KNOWN,
    },
    "forecast": {
        "run_id_present": _present("forecast_run_id"),
        "forecast_date_present": "forecast_date IS NOT NULL",
        "segment_keys_present": _present("site_id", "client_id", "model"),
        "forecast_non_negative": "forecast_downtime_minutes >= 0",
        "interval_lower_non_negative": "prediction_interval_lower_minutes >= 0",
        "interval_ordered": "prediction_interval_lower_minutes <= prediction_interval_upper_minutes",
        "forecast_in_interval": "forecast_downtime_minutes BETWEEN prediction_interval_lower_minutes AND prediction_interval_upper_minutes",
        "validation_count_non_negative": "validation_observation_count >= 0",
        "thresholds_paired": "(max_mae_downtime_minutes IS NULL) = (min_interval_coverage_pct IS NULL)",
        "mae_non_negative": _within("mae_downtime_minutes"),
        "coverage_in_range": _within("backtest_interval_coverage_pct", 0, 100),
        "validated_meets_all_gates": "forecast_status <> 'validated_baseline' OR (meets_min_validation_samples AND meets_mae_threshold AND meets_interval_coverage_threshold)",
    },
    "manifest": {
        "forecast_run_id_present": _present("forecast_run_id"),
        "publication_state_known": "publication_state IN ('STARTED', 'COMMITTED', 'FAILED')",
        "publication_started_at_present": "publication_started_at_utc IS NOT NULL",
        "row_counts_non_negative": "forecast_row_count >= 0 AND validation_row_count >= 0",
        "fingerprints_sha256_shaped": _each("length({}) = 64", tuple(f"{d}_{e}_sha256" for d in ("forecast", "validation") for e in ("schema", "payload"))),
        "committed_evidence_complete": "publication_state <> 'COMMITTED' OR publication_completed_at_utc IS NOT NULL",
    },
}


def evaluate(df: DataFrame, dataset: str, predicates: Mapping[str, str]) -> DataFrame:
    """dataset, expectation, passed_records, failed_records of each predicate, in one aggregation."""
    names = list(predicates)
    holds = {n: F.coalesce(F.expr(p), F.lit(False)) for n, p in predicates.items()}
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(~holds[n]).alias(n) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("expectation"), F.col(n).alias("failed")) for n in names])).alias("e")
    return one.select("_n", each).select(
        F.lit(dataset).alias("dataset"), "e.expectation", (F.col("_n") - F.col("e.failed")).alias("passed_records"), F.col("e.failed").alias("failed_records")
    )


def surplus_of_grain(df: DataFrame, grain: tuple[str, ...]) -> DataFrame:
    """One row with observed_count: rows beyond the first of each grain."""
    return df.groupBy(*grain).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("observed_count"))


#: The tables that are checked, in the order of the pipeline. All but quarantine must have rows.
TABLES = (
    "bronze", "silver", "quarantine", "gold_machine_uptime", "gold_failure_events", "gold_maintenance_costs", "gold_parts_usage", "gold_client_asset_summary",
    "dim_client", "dim_date", "dim_fault", "dim_machine", "dim_model", "dim_site", "fact_machine_failure_event", "fact_machine_uptime_daily",
)
_KEYS = {"fact_machine_uptime_daily": ("date_key", "client_key", "machine_key", "model_key", "site_key")}
_KEYS["fact_machine_failure_event"] = (*_KEYS["fact_machine_uptime_daily"], "fault_key")
#: The name and the columns of each table's grain.
GRAINS = {
    "silver": ("silver_event_id_unique", ("event_id",)),
    "fact_machine_uptime_daily": ("uptime_fact_grain_unique", ("date_key", "machine_key")),
    "fact_machine_failure_event": ("failure_fact_grain_unique", ("event_id",)),
}
_bounds = lambda *columns: " AND ".join(_within(c) for c in columns)
#: What every row of a table must fulfil.
PREDICATES = {
    "silver": {
        "silver_required_fields_present": _present("event_id", "machine_id", "event_ts_utc", "site_id", "client_id"),
        "silver_operational_metrics_in_bounds": _bounds("duration_minutes", "downtime_minutes", "maintenance_cost_gbp", "part_quantity") + " AND " + _within("fuel_level_pct", 0, 100),
    },
    "fact_machine_uptime_daily": {
        "uptime_fact_dimension_keys_present": _each("{} IS NOT NULL", _KEYS["fact_machine_uptime_daily"]),
        "uptime_fact_percentage_bounds": " AND ".join(_within(c, 0, 100) for c in ("uptime_pct", "idle_pct", "maintenance_pct")) + " AND " + _within("downtime_pct"),
        "uptime_fact_status_minutes_within_observed": STATUS_WITHIN,
        "uptime_fact_downtime_semantics_valid": f"{LOAD_VALID} AND {EXCEEDS_VALID} AND {VERSION_KNOWN}",
    },
    "fact_machine_failure_event": {
        "failure_fact_dimension_keys_present": _each("{} IS NOT NULL", _KEYS["fact_machine_failure_event"]),
        "failure_fact_measures_in_bounds": _bounds("failure_event_count", "downtime_minutes", "maintenance_cost_gbp", "part_quantity"),
    },
}


def readable(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What read gives, or None where its table isn't there or can't be resolved. Other errors are the caller's."""
    try:
        return read()
    except AnalysisException:
        return None


def quality(tables: Mapping[str, DataFrame | None], sources: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """check_name, status, severity, detail, observed_count of the tables named; one that is None counts as unreadable.

    A table named in sources must have as many rows as its source there. Each table is read once for its row count and
    predicates, and once more for its grain.
    """
    spark = next(df.sparkSession for df in tables.values() if df is not None)
    parts = []

    def result(name: str, bad: Column, seen: Column, good: str, broken: str) -> Column:
        return F.struct(
            F.lit(name).alias("check_name"),
            F.when(bad == 0, "pass").otherwise("fail").alias("status"),
            F.lit("error").alias("severity"),
            F.when(bad == 0, good).otherwise(broken).alias("detail"),
            seen.cast("bigint").alias("observed_count"),
        )

    for name, df in tables.items():
        if df is None:
            one = result(f"{name}_table_readable", F.lit(1), F.lit(1), "", "Table could not be read")
            parts.append(spark.range(1).select(one.alias("r")).select("r.*"))
            continue
        rules = PREDICATES.get(name, {})
        one = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(n) for n, p in rules.items()])
        found = [result(f"{name}_table_readable", F.lit(0), F.col("_n"), "Table is readable", "")]
        if name != "quarantine":
            empty = F.when(F.col("_n") == 0, 1).otherwise(0)
            found.append(result(f"{name}_table_populated", empty, empty, "Table has rows", "Table is empty"))
        found += [result(n, F.col(n), F.col(n), "All rows pass", "Rows break the check") for n in rules]
        if name in (sources or {}):
            one = one.crossJoin(F.broadcast(sources[name].agg(F.count("*").alias("_expected"))))  # one row each
            lost = F.abs(F.col("_n") - F.col("_expected"))
            found.append(result(f"{name}_source_rows_match", lost, lost, "As many rows as the source", "More or fewer rows than the source"))
        parts.append(one.select(F.explode(F.array(*found)).alias("r")).select("r.*"))
        if name in GRAINS:
            n = F.col("observed_count")
            parts.append(surplus_of_grain(df, GRAINS[name][1]).select(result(GRAINS[name][0], n, n, "All rows pass", "Rows break the check").alias("r")).select("r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record(results: DataFrame, run_id: str, checked_at: datetime, root: str) -> DataFrame:
    """Appends a run's results and its summary under root, then raises where an error check failed; else gives the summary.

    The evidence is there before anything fails. root is a folder that the cluster shares; results are written once and
    the summary is made of what was written.
    """
    stamp = [F.lit(run_id).alias("quality_run_id"), F.timestamp_micros(F.lit(int(checked_at.timestamp() * 1_000_000)).cast("bigint")).alias("checked_at")]
    results.select(*stamp, "*").write.mode("append").parquet(f"{root}/quality_check_results")
    written = results.sparkSession.read.parquet(f"{root}/quality_check_results").where(F.col("quality_run_id") == run_id)
    one = summary(written).select(*stamp, "*")
    one.write.mode("append").parquet(f"{root}/quality_metric_history")
    if failed := sorted(r.check_name for r in written.where("status = 'fail' and severity = 'error'").select("check_name").distinct().collect()):
        raise RuntimeError(f"quality run {run_id} failed: {', '.join(failed)}")
    return one


def summary(results: DataFrame) -> DataFrame:
    """One row of counts over quality results."""
    failed = F.col("status") == "fail"
    return results.agg(
        F.count("*").alias("check_count"),
        F.count_if(~failed).alias("passed_check_count"),
        F.count_if(failed).alias("failed_check_count"),
        F.count_if(failed & (F.col("severity") == "error")).alias("failed_error_check_count"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("failed_warning_check_count"),
    ).withColumn("all_error_checks_passed", F.col("failed_error_check_count") == 0)
