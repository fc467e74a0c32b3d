"""Gates, audits, evidence and operational reports on small inputs."""

import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrylake.operators import checks, downtime, malformed, marts, medallion, publication, star
from quarrylake.plans import operations
from test_catalogue import row, same
from test_problems import EVENTS

NOW = datetime(2026, 5, 1, 12, tzinfo=UTC)


@pytest.mark.parametrize(
    "name",
    [
        "star_audit", "star_measure_differences", "star_row_contract", "star_assignment_findings", "audit_downtime_star", "quality_results", "quality_summary", "assignment_findings", "assignment_rejected",
        "ops_quality_run_history", "ops_latest_quality_run", "ops_publication_attempts", "ops_alert_candidates", "ops_expectation_events", "ops_expectation_row_counts", "report_quality_monitoring",
        "report_forecast_backtest", "expectations_forecast", "expectations_manifest", "p6_loaded",
    ],
)
def test_queries(spark, data, name):
    same(spark, data, name)


def test_rounding(spark):
    cases = {-1.005: -1.01, -2.345: -2.35, 2.345: 2.35, 1.005: 1.01, 0.0049999995: 0.0, 0.005: 0.01, -0.001: 0.0, 1e17: 1e17, -1e30: -1e30, 1e300: 1e300, 33.333333: 33.33, 1.0049999999999999: 1.01}
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert {r.x: r.y for r in df.select("x", marts.two(F.col("x")).alias("y")).collect()} == cases
    assert df.limit(0).agg(marts.two(F.sum("x")).alias("y")).first().y is None


MINUTES = "running_minutes double, idle_minutes double, maintenance_minutes double, observed_minutes double, downtime_minutes double, downtime_pct double"


def counts(df):
    return {r.finding: r.observed_count for r in df.collect()}


def test_downtime_audits(spark):
    rows = [(30.0, 20.0, 10.0, 60.0, 15.0, 25.0), (0.0, 0.0, 0.0, 60.0, 120.0, 200.0), (0.0, 0.0, 0.0, 0.0, 30.0, None)]
    good = spark.createDataFrame(rows, MINUTES)
    assert counts(downtime.semantic_findings(good)) == {} and counts(downtime.semantic_findings(good.limit(0))) == {}
    bad = spark.createDataFrame([(None, 0.0, 0.0, 60.0, 0.0, 0.0), (-1.0, 0.0, 0.0, 60.0, 0.0, 0.0), (50.0, 20.0, 0.0, 60.0, 15.0, 26.0), (0.0, 0.0, 0.0, 60.0, 15.0, 25.009)], MINUTES)
    assert counts(downtime.semantic_findings(bad)) == {"required_semantic_value_missing": 1, "negative_duration_value": 1, "status_minutes_exceed_observed": 1, "legacy_downtime_pct_formula_mismatch": 1}
    assert counts(downtime.semantic_findings(good.drop("idle_minutes", "observed_minutes"))) == {"missing_semantic_columns": 2}
    full = downtime.materialise_or_validate(good.drop("downtime_pct"), "t")
    assert set(downtime.STATED) <= set(full.columns) and counts(downtime.materialised_findings(full)) == {}
    assert downtime.materialise_or_validate(full, "t") is full
    off = full.withColumns({"downtime_load_pct": F.lit(1.0), "downtime_exceeds_observed": F.lit(None).cast("boolean"), "downtime_semantics_version": F.lit("old")})
    assert set(counts(downtime.materialised_findings(off))) == {"downtime_load_formula_mismatch", "downtime_compatibility_alias_mismatch", "downtime_exceedance_flag_mismatch", "downtime_semantics_version_mismatch"}
    assert counts(downtime.materialised_findings(good)) == {"missing_materialized_downtime_columns": 3}
    for broken in (off, good, bad.drop("downtime_pct")):
        with pytest.raises(ValueError):
            downtime.materialise_or_validate(broken, "t")


@pytest.fixture(scope="module")
def two_marts(spark):
    rows = [row(i, m, site_id=s, model=x, status="FAULT", fault_code="HYD", severity="high") for i, (m, s, x) in enumerate([("M1", "S1", "X"), ("M2", "S2", "X"), ("M3", "S1", "Y")])]
    made = downtime.governed_marts(medallion.silver(spark.createDataFrame(rows, EVENTS)))
    assert set(made) == {"machine_uptime", "failure_events", "maintenance_costs", "parts_usage", "client_asset_summary"}
    return made["machine_uptime"], made["failure_events"]


def test_star_gates_and_contract(spark, two_marts):
    uptime, failures = two_marts
    s = downtime.governed_star(uptime, failures)
    assert star.publication_findings(s, uptime, failures).collect() == [] and star.row_contract(s, uptime, failures).collect() == []
    assert downtime.star_findings(s, uptime).collect() == []
    star.require_settled(uptime, failures)
    with pytest.raises(ValueError):
        star.require_settled(uptime.limit(0), failures)
    torn = uptime.unionByName(uptime.where("machine_id = 'M1'").withColumn("site_id", F.lit("S9"))).withColumn("model", F.when(F.col("machine_id") == "M2", F.lit(" ")).otherwise(F.col("model")))
    assert {(r.finding, r.observed_count) for r in star.assignment_findings(torn, failures.limit(0)).collect()} == {("same_day_assignment_conflict", 1), ("missing_assignment_identity", 1)}
    with pytest.raises(ValueError):
        star.require_settled(torn, failures)
    fact = s.fact_machine_failure_event
    broken = star.Star(
        **{
            **s.__dict__,
            "dim_fault": s.dim_fault.limit(0),
            "fact_machine_uptime_daily": s.fact_machine_uptime_daily.drop("site_key"),
            "fact_machine_failure_event": fact.unionByName(fact.where("event_id = 'E1'")).withColumn("event_id", F.when(F.col("event_id") != "E2", F.col("event_id"))),
        }
    )
    found = sorted((r.code, r.dataset, r.keys, r.detail) for r in star.row_contract(broken, torn, failures).collect() if r.code != "unmatched_dimension_key")
    f, u = "fact_machine_failure_event", "fact_machine_uptime_daily"
    assert found == [
        ("duplicate_failure_grain", f, "event_id=E1", "2"),
        ("machine_assignment_conflict", "machine_assignment", "event_date=2026-04-02,machine_id=M1", "2"),
        ("machine_assignment_conflict", "machine_assignment", "event_date=2026-04-02,machine_id=M2", "2"),
        ("missing_dimension_key", u, "", "site_key"),
        ("null_grain_key", f, "event_id=null", "event_id"),
        ("source_fact_count_mismatch", f, "", "3<>4"),
        ("source_fact_count_mismatch", u, "", "4<>3"),
    ]
    assert star.row_contract(broken, uptime, failures).where("code = 'unmatched_dimension_key' and detail = 'fault_key'").count() == 4


def test_quality_evidence_is_kept_before_it_fails(spark, tmp_path):
    df = spark.createDataFrame([("E1",)], "event_id string")
    good = checks.quality({"gold_parts_usage": df})
    one = checks.record(good, "q1", NOW, str(tmp_path))
    assert one.first().all_error_checks_passed
    with pytest.raises(RuntimeError, match="gold_parts_usage_table_populated"):
        checks.record(checks.quality({"gold_parts_usage": df.limit(0)}), "q2", NOW + timedelta(hours=1), str(tmp_path))
    history, results = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("quality_metric_history", "quality_check_results"))
    assert {(r.quality_run_id, r.failed_error_check_count) for r in history.collect()} == {("q1", 0), ("q2", 1)}
    shown = operations.quality_monitoring(history, results).collect()
    assert [(r.quality_run_id, r.check_name, r.severity) for r in shown] == [("q2", "gold_parts_usage_table_populated", "error")]
    first = operations.quality_monitoring(history.where("quality_run_id = 'q1'"), results).collect()
    assert [(r.quality_run_id, r.check_name) for r in first] == [("q1", None)]
    assert checks.readable(lambda: spark.read.parquet(f"{tmp_path}/nothing")) is None
    assert checks.readable(lambda: df) is df


def test_operational_reports(spark):
    history = spark.createDataFrame([("a", NOW - timedelta(hours=30, minutes=59), 5, 3, 2, 1, 1, False), ("b", NOW - timedelta(hours=30, minutes=59), 5, 5, 0, 2, 0, False)], "quality_run_id string, checked_at timestamp, check_count int, passed_check_count int, failed_check_count int, failed_error_check_count int, failed_warning_check_count int, all_error_checks_passed boolean")
    manifest = spark.createDataFrame(
        [("r1", "COMMITTED", NOW - timedelta(hours=9), NOW - timedelta(hours=8)), ("r2", "COMMITTED", NOW - timedelta(hours=7), NOW - timedelta(hours=6)), ("r3", "FAILED", NOW - timedelta(hours=5), None), ("r4", "STARTED", NOW - timedelta(minutes=61, seconds=59), None)],
        "forecast_run_id string, publication_state string, publication_started_at_utc timestamp, publication_completed_at_utc timestamp",
    ).withColumns({c: F.lit(1) for c in ("forecast_row_count", "validation_row_count", "forecast_payload_sha256", "validation_payload_sha256")})
    run = operations.latest_quality_run(history, NOW).collect()
    assert [(r.quality_run_id, r.evidence_age_hours) for r in run] == [("b", 30)]
    attempts = [(r.forecast_run_id, r.is_current_committed_run, r.started_age_minutes) for r in operations.publication_attempts(manifest, NOW).collect()]
    assert attempts == [("r4", False, 61), ("r3", False, None), ("r2", True, None), ("r1", False, None)]
    bronze = spark.createDataFrame([("x/machine-events__incremental__sha256_" + "a" * 64 + ".csv",), ("other.csv",), (None,)], "_source_file string")
    alerts = lambda m: [(r.alert_id, r.severity, r.evidence_id, r.observed_count) for r in operations.alert_candidates(history, m, bronze, NOW).collect()]
    assert alerts(manifest) == [
        ("invalid_ingestion_identity", "critical", "bronze_machine_events", 2), ("quality_error_check_failed", "critical", "b", 2),
        ("forecast_publication_stuck", "warning", "r4", 61), ("quality_evidence_stale", "warning", "b", 30),
    ]
    assert [a[0] for a in alerts(manifest.where("forecast_run_id <> 'r4'"))][0] == "forecast_publication_failed"
    assert [a[0] for a in alerts(manifest.limit(0))] == ["invalid_ingestion_identity", "quality_error_check_failed", "quality_evidence_stale"]
    assert operations.latest_quality_run(history.limit(0), NOW).collect() == [] and operations.publication_attempts(manifest.limit(0), NOW).collect() == []


def test_publication_audit_codes(spark, tmp_path):
    family = publication.Family(spark, str(tmp_path), "forecast")
    df = spark.range(3).withColumn("v", F.lit("x"))
    family.publish("r1", {"forecast": df, "validation": df.limit(1)})
    assert family.audit("r1", ["forecast", "validation"]) == [] and family.audit("r1", ["forecast", "other"]) == [("manifest_dataset_mismatch", "other"), ("manifest_dataset_mismatch", "validation")]
    pair = publication.pair_manifest(family.manifest()).first()
    assert (pair.forecast_run_id, pair.publication_state, pair.forecast_row_count, pair.validation_row_count, len(pair.validation_payload_sha256)) == ("r1", "COMMITTED", 3, 1, 64)
    assert family.create_views(["forecast"]) == "r1" and spark.table("forecast_forecast").count() == 3
    assert publication.Family(spark, str(tmp_path), "silver").current("a", df.schema).count() == 0
    family._log("r2", publication.COMMITTED, "2026-05-01T00:00:00Z", "{", "2026-05-01T00:00:00Z")
    assert family.audit("r2") == [("manifest_evidence_unreadable", "forecast")]
    for f in os.listdir(tmp_path / "forecast" / "run=r1"):
        os.remove(tmp_path / "forecast" / "run=r1" / f)
    assert family.audit("r1") == [("history_schema_unreadable", "forecast")]
    family._log("r1", publication.COMMITTED, "2026-05-01T00:00:00Z", "{}", "2026-05-01T00:00:00Z")
    assert family.audit("r1") == [("duplicate_manifest_run", "forecast")]
    assert publication.stamped(df, "r").first().publication_run_id == "r" and publication.stamped(publication.stamped(df, "r"), "r").count() == 3
    with pytest.raises(ValueError):
        publication.stamped(publication.stamped(df, "r"), "other")
    publication.bootstrap(df, f"{tmp_path}/empty")
    assert spark.read.parquet(f"{tmp_path}/empty").count() == 0
    publication.bootstrap(df.withColumn("w", F.lit(1)), f"{tmp_path}/empty")
    assert spark.read.parquet(f"{tmp_path}/empty").columns == ["id", "v"]


def test_retention(spark):
    old = NOW - timedelta(days=400)
    rows = [("forecast_history", f"c{i}", old + timedelta(days=i), "committed", False, False, 1) for i in range(4)]
    rows += [("forecast_history", "cur", old, "committed", True, False, 1), ("forecast_history", "rec", old, "committed", False, True, 1), ("forecast_history", "st", old, "started", False, False, 1)]
    rows += [("forecast_history", "new", NOW - timedelta(days=3), "failed", False, False, 1), ("forecast_history", "bad", old, "failed", None, None, 1), ("elsewhere", "x", old, "failed", False, False, 1)]
    plan = publication.retention_plan(spark.createDataFrame(rows, "dataset string, entry_id string, created_at timestamp, state string, current boolean, recovery_protected boolean, byte_count bigint"), NOW)
    assert {r.entry_id: r.protection for r in plan.collect()} == {
        "c0": None, "c1": None, "c2": "minimum_committed", "c3": "minimum_committed", "cur": "current", "rec": "recovery", "st": "started", "new": "recent", "bad": None, "x": "unmanaged",
    }
    assert publication.retention_findings(plan, NOW, NOW) == []
    assert publication.retention_findings(plan, NOW, NOW + timedelta(hours=25), max_candidates=2) == ["retention_inventory_capture_is_stale", "retention_candidate_count_exceeds_policy"]
    assert publication.retention_findings(plan, NOW, NOW - timedelta(hours=1)) == ["retention_inventory_capture_is_in_future"]


def test_every_declared_field_can_be_checked(spark):
    good = "L1,M1,2026-01-05T10:00:00Z,S,C,Crawler,12.5,telemetry,RUNNING,OK,none,61.0,2.2,50,60,0,0,NONE,0,day"
    lines = spark.createDataFrame([(1, good), (2, good.replace(",60,0,0,", ",x,0,?,")), (3, good.replace("61.0", ""))], "record_id bigint, raw_line string")
    sound, broken = malformed.load_lines(lines)
    assert {r.record_id: r.unread_columns for r in sound.collect()} == {1: None, 2: "duration_minutes,maintenance_cost_gbp", 3: None} and broken.count() == 0
    assert {tuple(r) for r in malformed.load_lines(lines, malformed.ALL_CHECKED)[1].collect()} == {(2, "duration_minutes")}


def test_expectations_of_events(spark):
    results = spark.createDataFrame([("d", "e", 3, 1), ("d", "f", 4, 0)], "dataset string, expectation string, passed_records bigint, failed_records bigint")
    got = [(r.event_type, r.level, r.message, r.details) for r in operations.expectation_events(results, NOW).collect()]
    assert got == [("update_progress", "INFO", "COMPLETED", '{"expectations":2}'), ("flow_progress", "WARN", "d: e", '{"passed_records":3,"failed_records":1}'), ("flow_progress", "INFO", "d: f", '{"passed_records":4,"failed_records":0}')]
    assert [r.row_count for r in operations.expectation_row_counts({"b": results, "a": results.limit(0)}).collect()] == [0, 2]
