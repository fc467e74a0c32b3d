"""Registered queries over the marts, the star and the reports. Instants come as UTC text, so that engines can be compared."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators import checks, conformance, downtime, forecast, history, marts, medallion, star
from quarrylake.plans import operations, reports
from quarrylake.plans.frames import Frames
from quarrylake.sources.landing import ingestion_coverage


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, UTC."""
    utc = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.select(*[utc(F.col(c)).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


TABLES: dict[str, Callable[[Frames], DataFrame]] = {
    "silver_events": lambda f: f.silver.drop("event_ts", "event_payload_sha256"),
    "silver_quarantine": lambda f: medallion.quarantine(f.bronze).select("event_id", "machine_id", "_ingested_at", "_source_file", "quarantine_reason", "is_conflicting_event_id"),
    "silver_reconciliation": lambda f: medallion.reconciliation(f.bronze),
    "mart_machine_uptime": lambda f: f.uptime,
    "mart_failure_events": lambda f: f.failures,
    "mart_maintenance_costs": lambda f: f.costs,
    "mart_parts_usage": lambda f: f.parts,
    "dim_machine": lambda f: f.star.dim_machine.drop("machine_key", "is_ambiguous"),
    "dim_date": lambda f: f.star.dim_date,
    "dim_fault": lambda f: f.star.dim_fault.drop("fault_key"),
    "dim_site": lambda f: f.star.dim_site.drop("site_key"),
    "fact_uptime_natural": lambda f: star.natural(f.star, "fact_machine_uptime_daily").select(
        "event_date", "client_id", "site_id", "machine_id", "model", "running_minutes", "idle_minutes", "maintenance_minutes", "downtime_minutes", "observed_minutes", "uptime_pct", "idle_pct", "downtime_pct", "maintenance_pct"
    ),
    "fact_failure_natural": lambda f: star.natural(f.star, "fact_machine_failure_event").select(
        "event_id", "event_date", "event_ts_utc", "client_id", "site_id", "machine_id", "model", "fault_code", "severity", "severity_rank", "downtime_minutes", "maintenance_cost_gbp", "part_code", "part_quantity"
    ),
    "star_unsettled_machines": lambda f: star.unsettled_machines(star.observations(f.uptime, f.failures)),
    "star_unsettled_days": lambda f: star.unsettled_days(star.observations(f.uptime, f.failures)),
    "star_audit": lambda f: star.audit(f.star, *f.staged),
    "star_identity_differences": lambda f: star.identity_differences(f.star, *f.staged),
    "star_measure_differences": lambda f: star.measure_differences(f.star, *f.staged),
}


#: The forecast's parameters in the registered queries.
FORECAST = (forecast.Config(28, 7, 14, 60.0, 60.0), "run-1", "2026-04-01T00:00:00Z")


#: The present time in the registered queries, so that they can be repeated.
NOW = datetime(2026, 5, 1, tzinfo=UTC)


def _quality(f: Frames) -> DataFrame:
    uptime, failures = f.staged
    silver, s = f.staged_slim, f.star
    marts_of = {
        "gold_machine_uptime": uptime,
        "gold_failure_events": failures,
        "gold_maintenance_costs": marts.maintenance_costs(silver),
        "gold_parts_usage": marts.parts_usage(silver),
        "gold_client_asset_summary": marts.asset_summary(marts.machine_days(silver)),
    }
    tables = {"bronze": f.bronze, "silver": silver, "quarantine": medallion.quarantine(f.bronze), **marts_of, **{n: getattr(s, n) for n in checks.TABLES if n.startswith(("dim_", "fact_"))}}
    return checks.quality({n: tables[n] for n in checks.TABLES}, {"fact_machine_uptime_daily": uptime, "fact_machine_failure_event": failures})


def _expected(f: Frames) -> dict[str, DataFrame]:
    return {"silver": f.silver, "uptime": f.uptime, "forecast": forecast.forecast(f.daily, *FORECAST), "manifest": f.manifest}


def _expectations(f: Frames) -> DataFrame:
    parts = [checks.evaluate(df, n, checks.EXPECTATIONS[n]) for n, df in _expected(f).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TABLES |= {
    "ingestion_coverage": lambda f: ingestion_coverage(f.bronze),
    "landing_conformance": lambda f: conformance.findings(f.bronze),
    "assignment_history": lambda f: history.with_sources(history.assignment_history(f.assignments), f.assignments),
    "assignment_resolution": lambda f: history.resolve(f.silver.select("event_id", "machine_id", "event_date"), history.assignment_history(f.assignments)),
    "assignment_audit": lambda f: history.audit(history.assignment_history(f.assignments)),
    "forecast_validation": lambda f: forecast.validation(f.daily, *FORECAST),
    "forecast_downtime": lambda f: forecast.forecast(f.daily, *FORECAST),
    "forecast_diagnostics": lambda f: forecast.diagnostics(forecast.validation(f.daily, *FORECAST)),
    "expectations_silver": lambda f: checks.evaluate(f.silver, "silver", checks.EXPECTATIONS["silver"]),
    "expectations_uptime": lambda f: checks.evaluate(f.uptime, "uptime", checks.EXPECTATIONS["uptime"]),
    "expectations_forecast": lambda f: checks.evaluate(forecast.forecast(f.daily, *FORECAST), "forecast", checks.EXPECTATIONS["forecast"]),
    "expectations_manifest": lambda f: checks.evaluate(f.manifest, "manifest", checks.EXPECTATIONS["manifest"]),
    "quality_results": _quality,
    "quality_summary": lambda f: checks.summary(_quality(f)),
    "assignment_findings": lambda f: history.evidence_findings(f.assignments),
    "assignment_rejected": lambda f: history.rejected_evidence(f.assignments),
    "star_assignment_findings": lambda f: star.assignment_findings(*f.staged),
    "star_publication_findings": lambda f: star.publication_findings(f.star, *f.staged),
    "star_row_contract": lambda f: star.row_contract(f.star, *f.staged),
    "audit_downtime_semantics": lambda f: downtime.semantic_findings(f.uptime),
    "audit_downtime_materialised": lambda f: downtime.materialised_findings(f.uptime),
    "audit_downtime_star": lambda f: downtime.star_findings(f.star, f.staged[0]),
    "ops_quality_run_history": lambda f: operations.quality_run_history(f.quality_history),
    "ops_latest_quality_run": lambda f: operations.latest_quality_run(f.quality_history, NOW),
    "ops_publication_attempts": lambda f: operations.publication_attempts(f.manifest, NOW),
    "ops_recent_publications": lambda f: operations.recent_publications(f.manifest),
    "ops_alert_candidates": lambda f: operations.alert_candidates(f.quality_history, f.manifest, f.bronze, NOW),
    "ops_expectation_events": lambda f: operations.expectation_events(_expectations(f), NOW),
    "ops_expectation_row_counts": lambda f: operations.expectation_row_counts(_expected(f)),
    "report_quality_monitoring": lambda f: operations.quality_monitoring(f.quality_history, operations.landing_checks(f.bronze)),
    "report_downtime_forecast": lambda f: operations.downtime_forecast(forecast.forecast(f.daily, *FORECAST)),
    "report_forecast_backtest": lambda f: operations.forecast_backtest(forecast.validation(f.daily, *FORECAST)),
}


def _query(build: Callable[[Frames], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(build(Frames(spark, sf_dir)))


QUERIES = {n: _query(b) for n, b in TABLES.items()} | {f"report_{r.__name__}": _query(r) for r in reports.REPORTS}
