"""Registered queries against their SQL, and the operators of the catalogue on small inputs."""

import math
import os
from datetime import UTC, date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarrylake.operators import checks, forecast, marts, medallion, star
from quarrylake.operators.publication import Family, fingerprint
from quarrylake.plans import problems, reports
from quarrylake.plans.frames import Frames
from quarrylake.sources import landing
from quarrylake.streaming.ingest import ingest

from test_problems import EVENTS


def norm(v):
    return repr(v) if isinstance(v, float) else None if v is None else str(v)


def same(spark, data, name):
    df = __spark_entry__.queries()[name](spark, data)
    with duckdb.connect() as con:
        con.execute("set TimeZone = 'UTC'")
        for f in os.listdir(data):
            con.execute(f"create view {f[:-8]} as from '{data}/{f}'")
        con.execute(__spark_entry__.oracle_sql()[name])
        names = [c[0] for c in con.description]
        want = [tuple(norm(v) for _, v in sorted(zip(names, r))) for r in con.fetchall()]
    got = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found"])
def test_problem_queries(spark, data, name):
    same(spark, data, name)


@pytest.mark.parametrize(
    "name",
    ["fact_failure_natural", "dim_site", "report_machine_fault_recurrence", "report_monthly_part_usage_concentration", "silver_events", "silver_quarantine", "silver_reconciliation", "mart_machine_uptime", "dim_machine", "report_monthly_reliability_trends", "report_maintenance_cost_drivers", "report_site_reliability_benchmark", "report_machine_part_usage_recurrence", "report_fault_impact_concentration", "forecast_downtime", "forecast_diagnostics", "expectations_uptime", "ingestion_coverage"],
)
def test_catalogue_queries(spark, data, name):
    same(spark, data, name)


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_problem_queries_on_empty_tables_and_null_rows(spark, data, tmp_path, kind):
    for name in ("sample_machine_events", "machine_assignments", "landed_lines"):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        nulls = df.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]).limit(5)
        (df.limit(0) if kind == "empty" else df.limit(20).unionByName(nulls).unionByName(nulls)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in problems.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert rows == [] if kind == "empty" else all(r[0] is not None for r in rows if name != "p6_found"), name


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def row(i, machine="M1", at=1, file="001.csv", **over):
    base = {
        "event_id": f"E{i}", "machine_id": machine, "event_ts": "2026-04-02T08:00:00Z", "site_id": "S1", "client_id": "C1", "model": "EXC", "hour_meter": "120.5", "event_type": " Telemetry ",
        "status": " running ", "fault_code": " ok ", "severity": " None ", "temperature_c": "72.0", "vibration_mm_s": "2.2", "fuel_level_pct": "60.0", "duration_minutes": "60", "downtime_minutes": "0",
        "maintenance_cost_gbp": "0.0", "part_code": " none ", "part_quantity": "0", "operator_shift": "DAY",
    }
    return (i, *(base | over).values(), datetime(2026, 4, at, tzinfo=UTC), file, None)


@pytest.fixture(scope="module")
def bronze(spark):
    rows = [
        row(1), row(1, at=3, file="004.csv"),  # replay
        row(2, "M2", status="fault", fault_code="hyd", temperature_c="95", vibration_mm_s="7.5", fuel_level_pct="15", downtime_minutes="120", maintenance_cost_gbp="250", part_code="pump", part_quantity="1", severity="HIGH"),
        row(3, event_ts="2026-04-01T08:00:00Z", at=5),  # late
        row(4, machine_id=" ", event_ts="not-a-timestamp"),
        row(5, duration_minutes="60"), row(5, duration_minutes="90"),  # conflict
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_silver_and_its_counts(bronze):
    silver = {r.event_id: r for r in medallion.silver(bronze).collect()}
    assert set(silver) == {"E1", "E2", "E3"} and silver["E1"]._source_file == "004.csv"
    assert (silver["E2"].health_score, silver["E2"].is_failure_event, silver["E1"].health_score, silver["E1"].status) == (15, True, 100, "RUNNING")
    quarantined = sorted((r.event_id, r.quarantine_reason) for r in medallion.quarantine(bronze).collect())
    assert quarantined == [("E4", medallion.INVALID), ("E5", medallion.CONFLICT), ("E5", medallion.CONFLICT)]
    assert tuple(medallion.reconciliation(bronze).first()) == (7, 6, 1, 2, 3, 3, 1, 1)
    with pytest.raises(ValueError):
        medallion.typed(bronze.drop("_source_file"))
    assert medallion.silver(bronze.limit(0)).collect() == [] and medallion.reconciliation(bronze.limit(0)).first().bronze_rows == 0


def test_downtime_may_exceed_observation(spark):
    df = marts.with_downtime_semantics(spark.createDataFrame([(120, 60), (30, 0), (0, 0)], "downtime_minutes int, observed_minutes int"))
    assert [(r.downtime_load_pct, r.downtime_exceeds_observed) for r in df.collect()] == [(200.0, True), (None, True), (0.0, False)]


def test_star_and_audits(spark, bronze):
    silver = medallion.silver(bronze)
    uptime, failures = marts.machine_uptime(silver), marts.failure_events(silver)
    s = star.build_star(uptime, failures)
    assert star.audit(s, uptime, failures).collect() == []
    assert all(r.observed_count == 0 for r in star.identity_differences(s, uptime, failures).collect())
    assert all(r.observed_count == 0 for r in star.measure_differences(s, uptime, failures).collect())
    broken = star.Star(**{**s.__dict__, "dim_fault": s.dim_fault.limit(0), "fact_machine_uptime_daily": s.fact_machine_uptime_daily.unionByName(s.fact_machine_uptime_daily.limit(1))})
    found = {(r.finding, r.dataset, r.detail): r.observed_count for r in star.audit(broken, uptime, failures).collect()}
    assert found == {
        ("unmatched_dimension_key", "fact_machine_failure_event", "fault_key"): 1,
        ("source_fact_count_mismatch", "fact_machine_uptime_daily", ""): 1,
        ("duplicate_fact_grain", "fact_machine_uptime_daily", ""): 1,
    }
    moved = star.Star(**{**s.__dict__, "fact_machine_failure_event": s.fact_machine_failure_event.withColumn("downtime_minutes", F.lit(1))})
    assert {(r.measure, r.observed_count) for r in star.measure_differences(moved, uptime, failures).where("observed_count > 0").collect()} == {("downtime_minutes", 1)}


def test_unsettled_machines_are_told(spark):
    up = spark.createDataFrame([(date(2026, 4, 1), "M1", "S1", "C1", "X"), (date(2026, 4, 1), "M1", "S2", "C1", "X"), (date(2026, 4, 1), "M2", "S1", "C1", " "), (date(2026, 4, 1), "M3", "S1", "C1", "X")], "event_date date, machine_id string, site_id string, client_id string, model string")
    assert {r.machine_id for r in star.unsettled_machines(star.observations(up, up)).collect()} == {"M1", "M2"}


def test_star_keeps_every_row(spark):
    place = [("M1", "S1", "X"), ("M1", "S2", "X"), ("M2", "S1", None)]
    rows = [row(i, m, site_id=s, model=x, status="FAULT", fault_code="HYD", severity="high") for i, (m, s, x) in enumerate(place)]
    rows += [row(i, "M1", model="X", event_ts=f"2026-04-0{d}T08:00:00Z") for i, d in ((7, 1), (8, 3))]
    silver = medallion.silver(spark.createDataFrame(rows, EVENTS))
    uptime, failures = marts.machine_uptime(silver), marts.failure_events(silver)
    s = star.build_star(uptime, failures)
    versions = [(r.machine_id, r.site_id, r.valid_from_date.day, r.valid_to_date and r.valid_to_date.day, r.is_ambiguous) for r in s.dim_machine.orderBy("machine_id", "assignment_version").collect()]
    days = [("M1", "S1", 1, 1, False), ("M1", "S1", 2, 2, True), ("M1", "S2", 2, 2, True), ("M1", "S1", 3, None, False), ("M2", "S1", 2, None, False)]
    assert versions == days
    for fact, source, names in (("fact_machine_uptime_daily", uptime, ["event_date", "machine_id", *star.PLACE]), ("fact_machine_failure_event", failures, ["event_id", "event_date", "machine_id", *star.PLACE])):
        got = sorted(map(tuple, star.natural(s, fact).select(*names).collect()), key=str)
        assert got == sorted(map(tuple, source.select(*names).collect()), key=str)
    assert {(r.machine_id, r.attribute_sets, r.lacks_attribute) for r in star.unsettled_days(star.observations(uptime, failures)).collect()} == {("M1", 2, False), ("M2", 1, True)}


def test_audits_tell_of_lost_rows(spark):
    rows = [row(i, m, site_id=s, model=x, status="FAULT", fault_code="HYD", severity="high") for i, (m, s, x) in enumerate([("M1", "S1", "X"), ("M1", "S2", "X"), ("M2", "S1", None), ("M3", "S1", "X")])]
    silver = medallion.silver(spark.createDataFrame(rows, EVENTS))
    uptime, failures = marts.machine_uptime(silver), marts.failure_events(silver)
    whole = star.build_star(uptime, failures)
    less = star.build_star(uptime.where("machine_id = 'M3'"), failures.where("machine_id = 'M3'"))
    facts = ("fact_machine_uptime_daily", "fact_machine_failure_event")
    assert star.audit(whole, uptime, failures).collect() == []
    assert {(r.finding, r.dataset, r.observed_count) for r in star.audit(less, uptime, failures).collect()} == {("source_fact_count_mismatch", d, 3) for d in facts}
    for s, lost in ((whole, 0), (less, 3)):
        assert {(r.finding, r.observed_count) for r in star.identity_differences(s, uptime, failures).collect()} == {("missing_fact_identity", lost), ("unexpected_fact_identity", 0)}
        assert {r.observed_count for r in star.measure_differences(s, uptime, failures).collect()} == {lost}
    got = {r.check_name: r.observed_count for r in checks.quality({d: getattr(less, d) for d in facts}, dict(zip(facts, (uptime, failures)))).where("status = 'fail'").collect()}
    assert got == {f"{d}_source_rows_match": 3 for d in facts}


DAYS = "event_date date, site_id string, client_id string, machine_id string, model string, downtime_minutes bigint, uptime_pct double, avg_health_score double"


@pytest.mark.parametrize(
    "seen, config, want",
    [
        ({1: 10, 2: 20, 5: 100}, (2, 1, 1), (100.0, 1, "thresholds_not_configured")),
        ({1: 10, 2: 10, 3: 10}, (2, 1, 2, 0.0, 100.0), (10.0, 2, "validated_baseline")),
        ({1: 10, 2: 20, 3: 40}, (2, 1, 2, 5.0, 80.0), (30.0, 2, "accuracy_threshold_failed")),
        ({1: 10}, (2, 1, 2, 100.0, 0.0), (10.0, 0, "insufficient_validation_history")),
    ],
)
def test_forecast(spark, seen, config, want):
    df = spark.createDataFrame([(date(2026, 4, d), "S", "C", "M", "X", v, 90.0, 80.0) for d, v in seen.items()], DAYS)
    got = forecast.forecast(forecast.daily_actuals(df), forecast.Config(*config), "r", "2026-05-01T00:00:00Z").first()
    assert (got.forecast_downtime_minutes, got.validation_observation_count, got.forecast_status) == want


def test_forecast_parameters():
    for bad in ((0, 1, 1), (1, 1, True), (1, 1, 1, 5.0), (1, 1, 1, math.nan, 5.0), (1, 1, 1, 5.0, 101.0)):
        with pytest.raises(ValueError):
            forecast.Config(*bad)
    with pytest.raises(ValueError):
        forecast.check_run("a b", "2026-05-01T00:00:00Z")


def test_quality_never_raises(spark, bronze):
    silver = medallion.silver(bronze)
    got = {r.check_name: r.status for r in checks.quality({"silver": silver.unionByName(silver.limit(1)), "quarantine": None}).collect()}
    assert got == {
        "silver_table_readable": "pass", "silver_table_populated": "pass", "silver_required_fields_present": "pass", "silver_operational_metrics_in_bounds": "pass",
        "silver_event_id_unique": "fail", "quarantine_table_readable": "fail",
    }
    one = checks.summary(checks.quality({"silver": silver})).first()
    assert (one.check_count, one.failed_check_count, one.all_error_checks_passed) == (5, 0, True)


def test_reports_can_be_ordered(spark, data):
    frames = Frames(spark, data)
    for r in (reports.daily_uptime_by_site_model, reports.machine_reliability_scorecard):
        assert reports.ordered(r.__name__, r(frames)).count() > 0
    assert {r.__name__ for r in reports.REPORTS} <= {n.removeprefix("report_") for n in __spark_entry__.queries() if n.startswith("report_")}


def test_failure_reports_count_every_failure(spark):
    rows = [row(i, m, site_id=s, model=x, status="FAULT", fault_code="HYD", severity="high", part_code="pump", part_quantity="1") for i, (m, s, x) in enumerate([("M1", "S1", "X"), ("M1", "S2", "X"), ("M2", "S1", None), ("M3", "S1", "X")])]
    frames = Frames(spark, "")
    frames.__dict__["bronze"] = spark.createDataFrame(rows, EVENTS)
    for r, count in (
        (reports.failure_events_by_fault, "failure_event_count"), (reports.machine_fault_recurrence, "observed_failure_event_count"), (reports.machine_part_usage_recurrence, "observed_part_event_count"),
        (reports.monthly_part_usage_concentration, "observed_part_event_count"), (reports.fault_impact_concentration, "failure_event_count"),
    ):
        assert sum(x[count] for x in r(frames).collect()) == 4


def test_publication(spark, tmp_path):
    family = Family(spark, str(tmp_path), "gold")
    one, two = (spark.createDataFrame([(i, f"v{n}") for i in range(20)], "k int, v string") for n in (1, 2))
    assert family.latest() is None and family.current("a") is None
    family.publish("r1", {"a": one, "b": one.limit(0)})
    family.publish("r2", {"a": two, "b": one.limit(0)})
    assert family.latest() == "r2" and family.current("a").first().v == "v2" and family.audit("r1") == []
    with pytest.raises(ValueError):
        family.publish("r2", {"a": one})
    with pytest.raises(RuntimeError):  # a dataset that changes between evidence and write

        class Odd(Family):
            @staticmethod
            def audit_frames(evidence, frames):
                return [("history_payload_mismatch", "a")]

        Odd(spark, str(tmp_path), "gold").publish("r3", {"a": one})
    assert family.latest() == "r2" and family.audit("r3") == [("run_not_committed", "gold")] and family.audit("r9") == [("missing_manifest_run", "gold")]
    two.write.mode("overwrite").parquet(f"{tmp_path}/a/run=r1")
    assert family.audit("r1") == [("history_payload_mismatch", "a")]
    assert [r.run_id for r in family.superseded(1).collect()] == ["r1"]
    assert fingerprint(one) == fingerprint(one.orderBy(F.desc("k")).select("v", "k"))
    assert fingerprint(one)["payload_sha256"] != fingerprint(one.unionByName(one.limit(1)))["payload_sha256"]


def test_landing_and_incremental_ingestion(spark, tmp_path):
    folder, source = tmp_path / "landing", tmp_path / "x.csv"
    folder.mkdir()
    header = "event_id,machine_id,event_ts,site_id,client_id,model,hour_meter,event_type,status,fault_code,severity,temperature_c,vibration_mm_s,fuel_level_pct,duration_minutes,downtime_minutes,maintenance_cost_gbp,part_code,part_quantity,operator_shift\n"
    source.write_text(header + "E1,M1\nE2,M1\n")
    path = landing.land(str(source), str(folder))
    assert landing.land(str(source), str(folder)) == path  # the same content lands once
    assert landing.parse_name(os.path.basename(path)).mode == "incremental" and landing.parse_name("events.csv") is None
    planned = landing.plan([str(source)])
    assert planned == landing.plan([str(source)]) and planned["files"][0]["name"] == os.path.basename(path)
    for bad in ([str(source), str(source)], [str(tmp_path)]):
        with pytest.raises(ValueError):
            landing.plan(bad)
    places = [str(tmp_path / n) for n in ("bronze", "checkpoint")]
    ingest(spark, str(folder), *places).awaitTermination()
    ingest(spark, str(folder), *places).awaitTermination()
    assert spark.read.parquet(places[0]).count() == 2
    source.write_text(header + "E3,M1\n")
    landing.land(str(source), str(folder), replay_id="rp-1")
    ingest(spark, str(folder), *places).awaitTermination()
    rows = spark.read.parquet(places[0])
    assert rows.count() == 3 and rows.where("_source_identity_valid").count() == 3
    assert {(r._ingestion_mode, r._replay_id) for r in rows.collect()} == {("incremental", None), ("backfill", "rp-1")}
    assert landing.unmanaged(spark, str(folder)).count() == 0
    (folder / "other.csv").write_text("x")
    assert landing.unmanaged(spark, str(folder)).count() == 1
    assert landing.read_csv(spark, str(folder)).where("event_id like 'E%'").count() == 3


def test_conformance(spark):
    from quarrylake.operators.conformance import findings

    rows = [row(1), row(1), row(2), row(2, status="x"), row(3, event_ts="2026-04-02T08:00:00+01:00", hour_meter="-1", fuel_level_pct="101", duration_minutes="007", downtime_minutes="9999999999", temperature_c="hot", machine_id=" ")]
    got = {(r["code"], r["column"]): r.observed_count for r in findings(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {
        ("required_key_missing", "machine_id"): 1, ("utc_timestamp_invalid", "event_ts"): 1, ("decimal_invalid", "temperature_c"): 1, ("integer_format_invalid", "duration_minutes"): 1,
        ("integer_range_violation", "downtime_minutes"): 1, ("non_negative_violation", "hour_meter"): 1, ("fuel_range_violation", "fuel_level_pct"): 1,
        ("replay_duplicate", "event_id"): 1, ("conflicting_duplicate", "event_id"): 1,
    }
    assert findings(spark.createDataFrame([], EVENTS)).collect() == []


def test_resolution_and_history_audit(spark):
    from quarrylake.operators.history import audit, resolve

    day = lambda d: date(2026, 4, d)
    chains = "machine_id string, effective_from date, effective_to date, is_current boolean, version int, client_id string, site_id string, model string"
    good = [("M1", day(1), day(4), False, 1, "C", "S1", "X"), ("M1", day(5), None, True, 2, "C", "S2", "X")]
    bad = [("M2", day(1), None, True, 1, "C", "S1", "X"), ("M2", day(3), day(2), False, 2, "C", " ", "X"), ("M2", day(3), None, True, 3, "C", "S3", "X")]
    counts = lambda rows: {r.finding.removeprefix("assignment_history_"): r.observed_count for r in audit(spark.createDataFrame(rows, chains)).collect()}
    assert set(counts(good).values()) == {0} and set(counts([]).values()) == {0}
    assert counts(bad) == {"grain_duplicate": 1, "identity_missing": 1, "range_overlap": 2, "current_member_invalid": 1, "range_invalid": 1}
    events = spark.createDataFrame([("a", "M1", day(4)), ("b", "M1", day(9)), ("c", "M1", date(2026, 3, 30)), ("d", "M2", day(9)), ("e", None, day(1)), ("f", "M1", None)], "event_id string, machine_id string, event_date date")
    got = {r.event_id: (r.resolution_status, r.match_count, r.resolved_site_id) for r in resolve(events, spark.createDataFrame(good + bad, chains)).collect()}
    assert got == {"a": ("resolved", 1, "S1"), "b": ("resolved", 1, "S2"), "c": ("unresolved", 0, None), "d": ("ambiguous", 2, None), "e": ("unresolved", 0, None), "f": ("unresolved", 0, None)}
