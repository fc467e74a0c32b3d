"""Audits, quality, evidence and operational reports as plain SQL, run by DuckDB."""

from quarrylake.plans.catalogue_sql import _E_SILVER, _E_UPTIME, _STAR_OBS, BRONZE, MARTS, _counting, two
from quarrylake.plans.catalogue_sql import SQL as CATALOGUE
from quarrylake.plans.problem_sql import _USABLE

_NOW = "timestamp '2026-05-01 00:00:00'"
_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
_SAME = lambda a, b, names: " and ".join(f"{a}.{n} is not distinct from {b}.{n}" for n in names)
_PLACE = ("machine_id", "site_id", "client_id", "model")

#: The star's facts as they come back from their versions: a row that meets none keeps a NULL version, one that meets two is there twice.
VERSIONS = (
    _STAR_OBS
    + f""",
sets as (select machine_id, event_date, list_sort(list({{'site_id': site_id, 'client_id': client_id, 'model': model}})) as s from seen_days group by all),
steps as (select *, lag(s) over (partition by machine_id order by event_date) as before from sets),
starts as (select *, lead(event_date) over (partition by machine_id order by event_date) as upto from steps where before is null or before is distinct from s),
unnested as (select machine_id, event_date, upto, unnest(s) as v from starts),
versions as (
  select machine_id, v.site_id as site_id, v.client_id as client_id, v.model as model, event_date as first, upto,
    row_number() over (partition by machine_id order by event_date, v.site_id nulls first, v.client_id nulls first, v.model nulls first) as version from unnested
),
up as (select u.*, v.version from uptime u left join versions v on {_SAME("u", "v", _PLACE)} and u.event_date >= v.first and (v.upto is null or u.event_date < v.upto)),
fe as (select u.*, v.version from failure_facts u left join versions v on {_SAME("u", "v", _PLACE)} and u.event_date >= v.first and (v.upto is null or u.event_date < v.upto))
"""
)
_FACTS = (("fact_machine_uptime_daily", "up", "uptime", "event_date, machine_id, version"), ("fact_machine_failure_event", "fe", "failures", "event_id"))
_IDENTITY = {"up": ("event_date", *_PLACE), "fe": ("event_id", "event_date", *_PLACE, "fault_code", "severity")}
_MEASURES = {
    "up": {"running_minutes": "run", "idle_minutes": "idle", "maintenance_minutes": "maint", "downtime_minutes": "down", "observed_minutes": "seen", "uptime_pct": "uptime_pct", "avg_health_score": "health", "downtime_load_pct": "load_pct"},
    "fe": {c: c for c in ("temperature_c", "vibration_mm_s", "downtime_minutes", "maintenance_cost_gbp", "part_code", "part_quantity")},
}


def _audit() -> str:
    parts = []
    for fact, rows, source, grain in _FACTS:
        parts += [
            f"select 'source_fact_count_mismatch' as finding, '{fact}' as dataset, '' as detail, abs((select count(*) from {rows}) - (select count(*) from {source})) as observed_count",
            f"select 'duplicate_fact_grain', '{fact}', '', (select count(*) from {rows}) - (select count(*) from (select distinct {grain} from {rows}))",
            f"select 'null_dimension_key', '{fact}', 'machine_key', (select count(*) from {rows} where version is null)",
        ]
    return " union all ".join(parts)


def _identities() -> str:
    parts = []
    for fact, rows, source, _ in _FACTS:
        names = ", ".join(_IDENTITY[rows])
        have, want = f"select {names} from {rows} where version is not null", f"select {names} from {source}"
        parts.append(f"select 'missing_fact_identity' as finding, '{fact}' as dataset, count(*) as observed_count from ({want} except {have})")
        parts.append(f"select 'unexpected_fact_identity', '{fact}', count(*) from ({have} except {want})")
    return " union all ".join(parts)


def _measures() -> str:
    parts = []
    for fact, rows, source, _ in _FACTS:
        keys = _IDENTITY[rows] if rows == "up" else ("event_id",)
        for name, c in _MEASURES[rows].items():
            both = f"(select *, true as there from {rows} where version is not null) f full join (select *, true as there from {source}) s on {_SAME('f', 's', keys)}"
            parts.append(f"select '{fact}' as dataset, '{name}' as measure, count(*) as observed_count from {both} where f.there is null or s.there is null or f.{c} is distinct from s.{c}")
    return " union all ".join(parts)


def _off(a: str, b: str) -> str:
    return f"({a} is distinct from {b} and coalesce(abs({a} - {b}) > 0.01, true))"


_LOAD = f"(case when seen > 0 then {two('cast(down as double) / seen * 100')} when down = 0 then 0.0 end)"
_SEMANTIC = {
    "required_semantic_value_missing": "run is null or idle is null or maint is null or seen is null or down is null",
    "negative_duration_value": "coalesce(run < 0, false) or coalesce(idle < 0, false) or coalesce(maint < 0, false) or coalesce(seen < 0, false) or coalesce(down < 0, false)",
    "status_minutes_exceed_observed": "coalesce(run, 0) + coalesce(idle, 0) + coalesce(maint, 0) > coalesce(seen, 0)",
    "legacy_downtime_pct_formula_mismatch": _off("load_pct", _LOAD),
}
_MATERIALISED = _SEMANTIC | {
    "downtime_load_formula_mismatch": _off("load_pct", _LOAD),
    "downtime_exceedance_flag_mismatch": "above is distinct from (down > seen)",
}


def _findings(rules: dict[str, str], table: str, dataset: str = "") -> str:
    extra = f", '{dataset}' as dataset" if dataset else ""
    return " union all ".join(f"select '{code}' as finding{extra}, count(case when {when} then 1 end) as observed_count from {table}" for code, when in rules.items())


_some = lambda cte, sql: f"with {cte} select * from ({sql}) where observed_count > 0"


def _quality() -> str:
    count = {
        "bronze": "bronze", "silver": "silver", "quarantine": "(select * from bronze where not is_valid or event_id in (select event_id from conflicts))", "gold_machine_uptime": "uptime",
        "gold_failure_events": "failures", "gold_maintenance_costs": "costs", "gold_parts_usage": "parts", "gold_client_asset_summary": "(select distinct client_id, site_id, machine_id, model from uptime)",
        "dim_client": "(select distinct client_id from seen_days)", "dim_date": "(select unnest(generate_series((select min(event_date) from seen_days), (select max(event_date) from seen_days), interval 1 day)))",
        "dim_fault": "(select distinct fault_code, severity from failures)", "dim_machine": "versions", "dim_model": "(select distinct model from seen_days)",
        "dim_site": "(select distinct site_id, client_id from seen_days)", "fact_machine_failure_event": "fe", "fact_machine_uptime_daily": "up",
    }
    parts = []
    for n, t in count.items():
        parts.append(f"select '{n}_table_readable' as check_name, 0 as bad, (select count(*) from {t}) as seen, 'Table is readable' as good, '' as broken")
        if n != "quarantine":
            empty = f"(select case when count(*) = 0 then 1 else 0 end from {t})"
            parts.append(f"select '{n}_table_populated', {empty}, {empty}, 'Table has rows', 'Table is empty'")

    def rule(name: str, number: str, good: str = "All rows pass", broken: str = "Rows break the check") -> None:
        parts.append(f"select '{name}', ({number}), ({number}), '{good}', '{broken}'")

    failing = lambda t, when: f"select count(*) - count(case when {when} then 1 end) from {t}"
    least = lambda *cs: " and ".join(f"({c} is null or {c} >= 0)" for c in cs)
    within = lambda c: f"({c} is null or {c} between 0 and 100)"
    present = " and ".join(f"trim({c}, ' ') <> ''" for c in ("event_id", "machine_id", "site_id", "client_id"))
    rule("silver_required_fields_present", failing("silver", f"{present} and event_ts_utc is not null"))
    rule("silver_operational_metrics_in_bounds", failing("silver", least("duration_minutes", "downtime_minutes", "maintenance_cost_gbp", "part_quantity") + " and " + within("fuel_level_pct")))
    rule("silver_event_id_unique", "select count(*) - count(distinct event_id) from silver")
    rule("uptime_fact_dimension_keys_present", "select count(*) from up where version is null")
    pct = lambda c: f"(case when seen > 0 then cast({c} as double) / seen * 100 end)"
    rule("uptime_fact_percentage_bounds", failing("up", f"{within('uptime_pct')} and {within(two(pct('idle')))} and {within(two(pct('maint')))} and {least('load_pct')}"))
    rule("uptime_fact_status_minutes_within_observed", failing("up", _E_UPTIME["status_minutes_within_observed"]))
    rule("uptime_fact_downtime_semantics_valid", failing("up", f"({_E_UPTIME['downtime_load_formula_valid']}) and ({_E_UPTIME['downtime_exceedance_flag_consistent']})"))
    rule("uptime_fact_grain_unique", "select count(*) - (select count(*) from (select distinct event_date, machine_id, version from up)) from up")
    rule("failure_fact_dimension_keys_present", "select count(*) from fe where version is null")
    rule("failure_fact_measures_in_bounds", failing("fe", least("downtime_minutes", "maintenance_cost_gbp", "part_quantity")))
    rule("failure_fact_grain_unique", "select count(*) - count(distinct event_id) from fe")
    for fact, rows, source, _ in _FACTS:
        rule(f"{fact}_source_rows_match", f"select abs((select count(*) from {rows}) - (select count(*) from {source}))", "As many rows as the source", "More or fewer rows than the source")
    return f"""with {VERSIONS}, r as ({" union all ".join(parts)})
      select check_name, case when bad = 0 then 'pass' else 'fail' end as status, 'error' as severity, case when bad = 0 then good else broken end as detail, cast(seen as bigint) as observed_count from r"""


_LANDED = {
    "required_keys_present": ("error", "not is_valid"),
    "durations_non_negative": ("error", "duration_minutes < 0 or downtime_minutes < 0"),
    "fuel_level_in_range": ("warning", "fuel_level_pct < 0 or fuel_level_pct > 100"),
    "hour_meter_present": ("warning", "hour_meter is null"),
}
_EACH = " union all ".join(f"select day, '{n}' as check_name, '{s}' as severity, count(case when {when} then 1 end) as observed_count from arrivals group by day" for n, (s, when) in _LANDED.items())
RUNS = (
    BRONZE
    + f""",
arrivals as (select *, cast(_ingested_at at time zone 'UTC' as date) as day from bronze where _ingested_at is not null),
results as (
  select 'landed-' || strftime(day, '%Y-%m-%d') as quality_run_id, cast(day + 1 as timestamp) as checked_at, check_name, case when observed_count > 0 then 'fail' else 'pass' end as status, severity,
    case when observed_count > 0 then 'Landed records break the check' else 'All landed records pass' end as detail, observed_count from ({_EACH})
),
history as (
  select quality_run_id, checked_at, count(*) as check_count, count_if(status <> 'fail') as passed_check_count, count_if(status = 'fail') as failed_check_count,
    count_if(status = 'fail' and severity = 'error') as failed_error_check_count, count_if(status = 'fail' and severity = 'warning') as failed_warning_check_count,
    count_if(status = 'fail' and severity = 'error') = 0 as all_error_checks_passed from results group by all
),
latest_run as (select * from history order by checked_at desc, quality_run_id desc limit 1),
files as (
  select _source_file as forecast_run_id, date_trunc('second', min(_ingested_at) at time zone 'UTC') as a, date_trunc('second', max(_ingested_at) at time zone 'UTC') as z, count(*) as forecast_row_count,
    count_if(is_valid) as validation_row_count, count_if({" or ".join(f"trim(coalesce({c}, ''), ' ') = ''" for c in ("event_id", "machine_id", "site_id", "client_id"))}) as k, count_if(epoch_s is null) as t
  from bronze group by all
),
manifest as (
  select forecast_run_id, case when k > 0 then 'FAILED' when t > 0 then 'STARTED' else 'COMMITTED' end as publication_state, a as publication_started_at_utc,
    case when k > 0 or t = 0 then z end as publication_completed_at_utc, forecast_row_count, validation_row_count,
    {", ".join(f"sha256('{c}|' || forecast_run_id) as {c}" for c in ("forecast_schema_sha256", "validation_schema_sha256", "forecast_payload_sha256", "validation_payload_sha256"))} from files
),
latest_attempt as (select * from manifest order by publication_started_at_utc desc, forecast_run_id desc limit 1)
"""
)
_AT = lambda c: f"{_ISO.format(c=c)} as {c}"
_E_FORECAST = {
    "run_id_present": "trim(forecast_run_id, ' ') <> ''",
    "forecast_date_present": "forecast_date is not null",
    "segment_keys_present": "trim(site_id, ' ') <> '' and trim(client_id, ' ') <> '' and trim(model, ' ') <> ''",
    "forecast_non_negative": "forecast_downtime_minutes >= 0",
    "interval_lower_non_negative": "prediction_interval_lower_minutes >= 0",
    "interval_ordered": "prediction_interval_lower_minutes <= prediction_interval_upper_minutes",
    "forecast_in_interval": "forecast_downtime_minutes between prediction_interval_lower_minutes and prediction_interval_upper_minutes",
    "validation_count_non_negative": "validation_observation_count >= 0",
    "thresholds_paired": "(max_mae_downtime_minutes is null) = (min_interval_coverage_pct is null)",
    "mae_non_negative": "mae_downtime_minutes is null or mae_downtime_minutes >= 0",
    "coverage_in_range": "backtest_interval_coverage_pct is null or backtest_interval_coverage_pct between 0 and 100",
    "validated_meets_all_gates": "forecast_status <> 'validated_baseline' or (meets_min_validation_samples and meets_mae_threshold and meets_interval_coverage_threshold)",
}
_E_MANIFEST = {
    "forecast_run_id_present": "trim(forecast_run_id, ' ') <> ''",
    "publication_state_known": "publication_state in ('STARTED', 'COMMITTED', 'FAILED')",
    "publication_started_at_present": "publication_started_at_utc is not null",
    "row_counts_non_negative": "forecast_row_count >= 0 and validation_row_count >= 0",
    "fingerprints_sha256_shaped": " and ".join(f"length({d}_{e}_sha256) = 64" for d in ("forecast", "validation") for e in ("schema", "payload")),
    "committed_evidence_complete": "publication_state <> 'COMMITTED' or publication_completed_at_utc is not null",
}
_SETS = {"silver": _E_SILVER, "uptime": _E_UPTIME, "forecast": _E_FORECAST, "manifest": _E_MANIFEST}
#: CTEs of different names for the four tables that have expectations.
_ALL = f"{MARTS}, {RUNS.replace(BRONZE, '', 1).lstrip().removeprefix(',')}, forecast as ({CATALOGUE['forecast_downtime']})"


def _expectations(*tables: str) -> str:
    one = lambda t, n, p: f"select '{t}' as dataset, '{n}' as expectation, count(case when {p} then 1 end) as passed_records, count(*) - count(case when {p} then 1 end) as failed_records from {t}"
    return " union all ".join(one(t, n, p) for t in tables for n, p in _SETS[t].items())


_FORECAST_COLUMNS = """forecast_run_id, forecast_generated_at, forecast_date, latest_actual_date, site_id, client_id, model, window_semantics, baseline_window_days, forecast_horizon_days, machine_count,
  forecast_downtime_minutes, prediction_interval_lower_minutes, prediction_interval_upper_minutes, validation_observation_count, mae_downtime_minutes, rmse_downtime_minutes, backtest_interval_coverage_pct,
  thresholds_configured, max_mae_downtime_minutes, min_interval_coverage_pct, meets_min_validation_samples, meets_mae_threshold, meets_interval_coverage_threshold, forecast_status"""
_RUN = "failed_error_check_count, failed_warning_check_count, all_error_checks_passed"
_CONFLICT_DAYS = f"""{_USABLE},
evidence as (
  select distinct cast(event_date as date) as event_date, {", ".join(f"nullif(trim({c}, ' '), '') as {c}" for c in ("machine_id", "client_id", "site_id", "model", "assignment_evidence_source"))} from machine_assignments
),
conflict_days as (select machine_id, event_date from usable group by all having count(distinct row(client_id, site_id, model)) > 1)
"""
_MISSING = " or ".join(f"{c} is null" for c in ("event_date", "machine_id", "client_id", "site_id", "model"))

SQL = {
    "star_audit": _some(VERSIONS, _audit()),
    "star_identity_differences": f"with {VERSIONS} {_identities()}",
    "star_measure_differences": f"with {VERSIONS} {_measures()}",
    "star_publication_findings": _some(
        VERSIONS,
        f"{_audit()} union all select finding, dataset, '', observed_count from ({_identities()}) union all select 'fact_measure_mismatch', dataset, measure, observed_count from ({_measures()})",
    ),
    "star_assignment_findings": _some(
        _STAR_OBS,
        f"""select 'same_day_assignment_conflict' as finding, 'machine_assignment' as dataset, count(case when attribute_sets > 1 then 1 end) as observed_count from unsettled
        union all select 'missing_assignment_identity', 'machine_assignment', count(case when lacks_attribute then 1 end) from unsettled""",
    ),
    "star_row_contract": f"""with {_STAR_OBS} select 'machine_assignment_conflict' as code, 'machine_assignment' as dataset, 'event_date=' || event_date || ',machine_id=' || machine_id as keys,
      cast(attribute_sets as varchar) as detail from unsettled where attribute_sets > 1""",
    "audit_downtime_semantics": _some(MARTS, _findings(_SEMANTIC, "uptime")),
    "audit_downtime_materialised": _some(MARTS, _findings(_MATERIALISED, "uptime")),
    "audit_downtime_star": _some(VERSIONS, f"{_findings(_MATERIALISED, 'uptime', 'machine_uptime')} union all {_findings(_MATERIALISED, 'up', 'fact_machine_uptime_daily')}"),
    "quality_results": _quality(),
    "quality_summary": f"""with q as ({_quality()}) select count(*) as check_count, count_if(status <> 'fail') as passed_check_count, count_if(status = 'fail') as failed_check_count,
      count_if(status = 'fail') as failed_error_check_count, cast(0 as bigint) as failed_warning_check_count, count_if(status = 'fail') = 0 as all_error_checks_passed from q""",
    "assignment_findings": _some(
        _CONFLICT_DAYS,
        f"""select 'missing_assignment_identity' as finding, count(*) as observed_count
        from (select cast(event_date as date) as event_date, {", ".join(f"nullif(trim({c}, ' '), '') as {c}" for c in ("machine_id", "client_id", "site_id", "model"))} from machine_assignments) where {_MISSING}
        union all select 'same_day_assignment_conflict', count(*) from conflict_days""",
    ),
    "assignment_rejected": f"""with {_CONFLICT_DAYS} select event_date, machine_id, client_id, site_id, model, assignment_evidence_source from evidence
      where {_MISSING} or (machine_id, event_date) in (select (machine_id, event_date) from conflict_days)""",
    "ops_quality_run_history": f"with {RUNS} select * replace ({_ISO.format(c='checked_at')} as checked_at) from history order by checked_at desc, quality_run_id desc limit 30",
    "ops_latest_quality_run": f"with {RUNS} select * replace ({_ISO.format(c='checked_at')} as checked_at), date_sub('hour', checked_at, {_NOW}) as evidence_age_hours from latest_run",
    "ops_publication_attempts": f"""with {RUNS} select forecast_run_id, publication_state, {_AT("publication_started_at_utc")}, {_AT("publication_completed_at_utc")}, forecast_row_count, validation_row_count,
      forecast_payload_sha256, validation_payload_sha256, coalesce(forecast_run_id = (select forecast_run_id from manifest where publication_state = 'COMMITTED'
        order by publication_completed_at_utc desc, forecast_run_id desc limit 1), false) as is_current_committed_run,
      case when publication_state = 'STARTED' then date_sub('minute', m.publication_started_at_utc, {_NOW}) end as started_age_minutes from manifest m
      order by m.publication_started_at_utc desc, forecast_run_id desc limit 100""",
    "ops_recent_publications": f"""with {RUNS} select * replace ({_AT("publication_started_at_utc")}, {_AT("publication_completed_at_utc")})
      from (select * from manifest order by publication_started_at_utc desc, forecast_run_id desc limit 30)""",
    "ops_alert_candidates": f"""with {RUNS}, identity as (
        select count_if(not (regexp_matches(name, '^machine-events__incremental__sha256_[0-9a-f]{{64}}[.]csv$') or regexp_matches(name, '^machine-events__backfill__replay_[A-Za-z0-9._-]{{1,64}}__sha256_[0-9a-f]{{64}}[.]csv$'))) as n
        from (select coalesce(regexp_extract(_source_file, '([^/]+)$', 1), '') as name from sample_machine_events)
      )
      select 'quality_error_check_failed' as alert_id, 'critical' as severity, 'data_engineering' as owner_role, quality_run_id as evidence_id, {_ISO.format(c="checked_at")} as observed_at,
        failed_error_check_count as observed_count from latest_run where failed_error_check_count > 0
      union all select 'quality_evidence_stale', 'warning', 'data_engineering', quality_run_id, {_ISO.format(c="checked_at")}, date_sub('hour', checked_at, {_NOW}) from latest_run where date_sub('hour', checked_at, {_NOW}) >= 24
      union all select 'forecast_publication_failed', 'critical', 'data_engineering', forecast_run_id, {_ISO.format(c="publication_started_at_utc")}, 1 from latest_attempt where publication_state = 'FAILED'
      union all select 'forecast_publication_stuck', 'warning', 'data_engineering', forecast_run_id, {_ISO.format(c="publication_started_at_utc")}, date_sub('minute', publication_started_at_utc, {_NOW})
        from latest_attempt where publication_state = 'STARTED' and date_sub('minute', publication_started_at_utc, {_NOW}) > 60
      union all select 'invalid_ingestion_identity', 'critical', 'data_engineering', 'bronze_machine_events', {_ISO.format(c=_NOW)}, n from identity where n > 0""",
    "report_quality_monitoring": f"""with {RUNS} select l.quality_run_id, {_ISO.format(c="l.checked_at")} as checked_at, {_RUN}, severity, check_name, status, detail, observed_count
      from latest_run l left join results r on r.quality_run_id = l.quality_run_id and r.status = 'fail'""",
    "report_downtime_forecast": f"select {_FORECAST_COLUMNS} from ({CATALOGUE['forecast_downtime']})",
    "report_forecast_backtest": f"""with v as ({CATALOGUE["forecast_validation"]}) select forecast_run_id, validation_generated_at, site_id, client_id, model, window_semantics, baseline_window_days,
      count(*) as validation_observation_count, {two("avg(absolute_error_minutes)")} as mae_downtime_minutes, {two("sqrt(avg(squared_error_minutes))")} as rmse_downtime_minutes,
      {two("avg(absolute_percentage_error) * 100")} as mape_pct, {two("avg(case when covered_by_validation_interval then 1.0::double else 0.0::double end) * 100")} as backtest_interval_coverage_pct,
      max(event_date) as latest_validation_date from v group by all""",
    "expectations_forecast": f"with forecast as ({CATALOGUE['forecast_downtime']}) {_expectations('forecast')}",
    "expectations_manifest": f"with {RUNS} {_expectations('manifest')}",
    "ops_expectation_row_counts": f"with {_ALL} " + " union all ".join(f"select 'quality_expectation_{t}' as expectation_dataset, count(*) as row_count from {t}" for t in _SETS),
    "ops_expectation_events": f"""with {_ALL}, e as ({_expectations(*_SETS)})
      select '2026-05-01T00:00:00Z' as timestamp, 'flow_progress' as event_type, case when failed_records > 0 then 'WARN' else 'INFO' end as level, dataset || ': ' || expectation as message,
        '{{"passed_records":' || passed_records || ',"failed_records":' || failed_records || '}}' as details from e
      union all select '2026-05-01T00:00:00Z', 'update_progress', 'INFO', 'COMPLETED', '{{"expectations":' || (select count(*) from e) || '}}'""",
}
SQL = {name: _counting(sql) for name, sql in SQL.items()}
