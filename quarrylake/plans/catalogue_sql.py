"""The catalogue's results as plain SQL, run by DuckDB."""

from quarrylake.plans.problem_sql import _USABLE, TS_SHAPE, _epoch, _num


def two(x: str) -> str:
    return f"coalesce(cast(round(try_cast({x} as decimal(38,10)), 2) as double), cast({x} as double))"


def share(a: str, b: str) -> str:
    return f"(case when {b} > 0 then {two(f'cast({a} as double) / {b} * 100')} end)"


def ratio(a: str, b: str) -> str:
    return f"(case when {b} > 0 then {two(f'cast({a} as double) / {b}')} end)"


def _int(c: str) -> str:
    return f"cast(trunc({_num(c)}) as integer)"


_RAW = "event_id, machine_id, event_ts, site_id, client_id, model, hour_meter, event_type, status, fault_code, severity, temperature_c, vibration_mm_s, fuel_level_pct, duration_minutes, downtime_minutes, maintenance_cost_gbp, part_code, part_quantity, operator_shift"
_BLANK = lambda c: f"trim(coalesce({c}, ''), ' ') = ''"

BRONZE = f"""
bronze as (
  select event_id, machine_id, site_id, client_id, model, operator_shift, _ingested_at, _source_file,
    {", ".join(f"{_num(c)} + 0.0 as {c}" for c in ("hour_meter", "temperature_c", "vibration_mm_s", "fuel_level_pct"))},
    {_num("maintenance_cost_gbp")} as cost, {_int("duration_minutes")} as duration_minutes, {_int("downtime_minutes")} as downtime_minutes, {_int("part_quantity")} as quantity,
    lower(trim(event_type, ' ')) as event_type, lower(trim(severity, ' ')) as severity, upper(trim(status, ' ')) as status,
    upper(trim(part_code, ' ')) as part_code, upper(trim(fault_code, ' ')) as fault_code,
    {_epoch("event_ts")} as epoch_s, row({_RAW}) as payload,
    not ({_BLANK("event_id")} or {_BLANK("machine_id")} or {_BLANK("site_id")} or {_BLANK("client_id")}) and {_epoch("event_ts")} is not null as is_valid
  from sample_machine_events
),
conflicts as (select event_id from bronze where not ({_BLANK("event_id")}) group by event_id having count(distinct payload) > 1)
"""
SILVER = (
    BRONZE
    + """,
silver as (
  select *, make_timestamp(epoch_s * 1000000) as event_ts_utc, cast(make_timestamp(epoch_s * 1000000) as date) as event_date,
    status = 'FAULT' or (fault_code is not null and fault_code <> 'OK') as is_failure_event,
    greatest(0, 100 - case when temperature_c > 90 then 20 else 0 end - case when vibration_mm_s > 6 then 25 else 0 end
      - case when fuel_level_pct < 20 then 10 else 0 end - case when status = 'FAULT' then 30 else 0 end) as health_score,
    coalesce(cost, 0.0) as maintenance_cost_gbp, coalesce(quantity, 0) as part_quantity
  from bronze where is_valid and event_id not in (select event_id from conflicts)
  qualify row_number() over (partition by event_id order by _ingested_at desc nulls last, _source_file desc nulls last) = 1
)
"""
)
_TS = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
_BIG = lambda x, n: f"cast({x} as bigint) as {n}"


def _load(c: str) -> str:
    return f"(case when seen > 0 then {two(f'cast({c} as double) / seen * 100')} when {c} = 0 then 0.0 end)"


MARTS = (
    SILVER
    + f""",
days as (
  select event_date, site_id, client_id, machine_id, model,
    {", ".join(_BIG(f"sum(case when status = '{s}' then duration_minutes else 0 end)", n) for s, n in (("RUNNING", "run"), ("IDLE", "idle"), ("MAINTENANCE", "maint")))},
    {_BIG("sum(coalesce(downtime_minutes, 0))", "down")}, {_BIG("sum(coalesce(duration_minutes, 0))", "seen")}, avg(health_score) as health
  from silver group by all
),
uptime as (select *, {share("run", "seen")} as uptime_pct, {_load("down")} as load_pct, down > seen as above from days),
failures as (select * from silver where is_failure_event),
costs as (
  select cast(date_trunc('month', event_date) as date) as event_month, site_id, client_id, model, count_if(status = 'MAINTENANCE') as maint_n,
    count_if(is_failure_event) as fail_n, {two("sum(maintenance_cost_gbp)")} as cost, {_BIG("sum(downtime_minutes)", "down")}
  from silver group by all
),
parts as (
  select event_date, site_id, client_id, model, part_code, {_BIG("sum(part_quantity)", "q")}, {two("sum(maintenance_cost_gbp)")} as cost, count(distinct machine_id) as machines
  from silver where part_code <> 'NONE' and part_quantity > 0 group by all
)
"""
)

_RANK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as severity_rank"
_STAR_OBS = (
    MARTS
    + f""",
seen_days as (select event_date, machine_id, site_id, client_id, model from uptime union select event_date, machine_id, site_id, client_id, model from failures),
unsettled as (
  select machine_id, event_date, count(*) as attribute_sets,
    bool_or({" or ".join(f"trim(coalesce({c}, ''), ' ') = ''" for c in ("machine_id", "site_id", "client_id", "model"))}) as lacks_attribute
  from seen_days group by machine_id, event_date having attribute_sets > 1 or lacks_attribute
),
failure_facts as (select *, {_RANK} from failures)
"""
)
_ALL_DOWN = "coalesce(downtime_minutes, 0)"
_FK = "client_id, site_id, model, fault_code, severity, severity_rank"

MONTHLY = (
    MARTS
    + f""",
m_seen as (
  select cast(date_trunc('month', event_date) as date) as event_month, client_id, site_id, model, count(distinct machine_id) as machines,
    {_BIG("sum(coalesce(run, 0))", "run")}, {_BIG("sum(seen)", "seen")}, {_BIG("sum(down)", "down")}, {two("avg(health)")} as health
  from uptime group by all
),
m_fail as (
  select cast(date_trunc('month', event_date) as date) as event_month, client_id, site_id, model, count(*) as n, count(distinct machine_id) as affected,
    {_BIG(f"sum({_ALL_DOWN})", "lost")}, sum(maintenance_cost_gbp) as cost
  from failures group by all
),
m_keys as (select event_month, client_id, site_id, model from m_seen union select event_month, client_id, site_id, model from m_fail),
monthly as (
  select k.*, coalesce(s.machines, 0) as machines, coalesce(s.run, 0) as run, coalesce(s.seen, 0) as seen, coalesce(s.down, 0) as down, s.health,
    case when s.event_month is not null then 'attributed_incident_v1' end as version,
    coalesce(f.n, 0) as n, coalesce(f.affected, 0) as affected, coalesce(f.lost, 0) as lost, coalesce(f.cost, 0.0) as cost
  from m_keys k
  left join m_seen s on s.event_month = k.event_month and s.client_id = k.client_id and s.site_id = k.site_id and s.model is not distinct from k.model
  left join m_fail f on f.event_month = k.event_month and f.client_id = k.client_id and f.site_id = k.site_id and f.model is not distinct from k.model
)
"""
)


def _recurrence(source: str, keys: str, sums: str) -> str:
    return f"""
days_of as (select distinct {keys}, event_date from {source}),
gaps as (select *, date_diff('day', lag(event_date) over (partition by {keys} order by event_date), event_date) as gap from days_of),
gap_sum as (select {keys}, count(gap) as intervals, min(gap) as min_gap, avg(gap) as avg_gap, max(gap) as max_gap from gaps group by all),
summed as (
  select {keys}, min(event_date) as first, max(event_date) as latest, min(event_ts_utc) as first_at, max(event_ts_utc) as latest_at, count(*) as n,
    count(distinct event_id) as ids, count(distinct event_date) as days, count(distinct date_trunc('month', event_date)) as months, {sums}
  from {source} group by all
),
r as (select s.*, g.intervals, g.min_gap, g.avg_gap, g.max_gap from summed s join gap_sum g on {" and ".join(f"s.{k} is not distinct from g.{k}" for k in keys.split(", "))})
"""


def _repeat(word: str, part: str) -> str:
    return f"case when n <= 1 then 'single_observed_{word}_event' when days = 1 then 'repeat_{part}events_on_one_observed_day' when months = 1 then 'repeat_{part}events_across_observed_days' else 'repeat_{part}events_across_observed_months' end"


def _shares(measures: dict[str, str], order: str) -> str:
    g = "partition by event_month, client_id, site_id, model"
    out = []
    for m, p in measures.items():
        t, c = f"sum({m}) over ({g})", f"sum({m}) over ({g} order by {order} rows unbounded preceding)"
        cast = "double" if "cost" in m else "bigint"
        out += [f"cast({t} as {cast}) as total_{m}", f"{share(m, t)} as {p}_share_pct", f"{share(c, t)} as cumulative_{p}_share_pct"]
    return ", ".join(out)


_PART_ORDER = "recorded_part_quantity desc, observed_part_event_count desc, associated_failure_cost_gbp desc, associated_attributed_downtime_minutes desc, part_code"
_FAULT_ORDER = "failure_event_count desc, attributed_downtime_minutes desc, maintenance_cost_gbp desc, severity_rank desc, fault_code, severity"
_R_KEYS = "client_id, site_id, machine_id, model, fault_code, severity, severity_rank"

SQL = {
    "silver_quarantine": f"""with {BRONZE} select event_id, machine_id, strftime(_ingested_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as _ingested_at, _source_file,
      case when not is_valid then 'Missing or invalid required business key' else 'Conflicting payloads share the same event ID' end as quarantine_reason,
      event_id in (select event_id from conflicts) as is_conflicting_event_id
      from bronze where not is_valid or event_id in (select event_id from conflicts)""",
    "silver_reconciliation": f"""with {SILVER}, c as (select count(*) as b, count_if(is_valid) as v, count_if(is_valid and event_id in (select event_id from conflicts)) as k from bronze)
      select b as bronze_rows, v as valid_rows_before_deduplication, b - v as invalid_quarantine_rows, k as conflicting_quarantine_rows, b - v + k as quarantine_rows,
      s as silver_rows, v - k - s as deduplicated_rows, n as conflicting_event_ids from c, (select count(*) as s from silver), (select count(*) as n from conflicts)""",
    "mart_machine_uptime": f"""with {MARTS} select event_date, site_id, client_id, machine_id, model, run as running_minutes, idle as idle_minutes, maint as maintenance_minutes, down as downtime_minutes,
      seen as observed_minutes, health as avg_health_score, uptime_pct, load_pct as downtime_load_pct, load_pct as downtime_pct, above as downtime_exceeds_observed,
      'attributed_incident_v1' as downtime_semantics_version from uptime""",
    "mart_failure_events": f"""with {MARTS} select event_id, event_date, {_TS.format(c="event_ts_utc")} as event_ts_utc, site_id, client_id, machine_id, model, fault_code, severity, temperature_c,
      vibration_mm_s, downtime_minutes, maintenance_cost_gbp, part_code, part_quantity from failures""",
    "mart_maintenance_costs": f"with {MARTS} select event_month, site_id, client_id, model, maint_n as maintenance_event_count, fail_n as failure_event_count, cost as maintenance_cost_gbp, down as downtime_minutes from costs",
    "mart_parts_usage": f"with {MARTS} select event_date, site_id, client_id, model, part_code, q as part_quantity, cost as associated_cost_gbp, machines as machine_count from parts",
    "dim_machine": f"""with {_STAR_OBS}, sets as (select machine_id, event_date, list_sort(list({{'site_id': site_id, 'client_id': client_id, 'model': model}})) as s from seen_days group by all),
      steps as (select *, lag(s) over (partition by machine_id order by event_date) as before from sets),
      starts as (select *, lead(event_date) over (partition by machine_id order by event_date) as upto from steps where before is null or before is distinct from s),
      versions as (select machine_id, event_date, upto, unnest(s) as v from starts)
      select machine_id, v.site_id as site_id, v.client_id as client_id, v.model as model,
        cast(row_number() over (partition by machine_id order by event_date, v.site_id nulls first, v.client_id nulls first, v.model nulls first) as integer) as assignment_version,
        event_date as valid_from_date, upto - 1 as valid_to_date, upto is null as is_current from versions""",
    "dim_date": f"""with {_STAR_OBS}, d as (select unnest(generate_series((select min(event_date) from seen_days), (select max(event_date) from seen_days), interval 1 day))::date as date_day)
      select cast(strftime(date_day, '%Y%m%d') as integer) as date_key, date_day, cast(year(date_day) as integer) as year, cast(quarter(date_day) as integer) as quarter,
        cast(month(date_day) as integer) as month, strftime(date_day, '%B') as month_name, cast(strftime(date_day, '%Y%m') as integer) as year_month_key, strftime(date_day, '%Y-%m') as year_month,
        cast(day(date_day) as integer) as day_of_month, cast(dayofweek(date_day) + 1 as integer) as day_of_week, strftime(date_day, '%A') as day_name, cast(weekofyear(date_day) as integer) as week_of_year,
        dayofweek(date_day) in (0, 6) as is_weekend from d""",
    "dim_fault": f"with {_STAR_OBS} select distinct fault_code, severity, severity_rank from failure_facts",
    "dim_site": f"with {_STAR_OBS} select distinct site_id, client_id from seen_days",
    "fact_uptime_natural": f"""with {_STAR_OBS} select event_date, client_id, site_id, machine_id, model, run as running_minutes, idle as idle_minutes, maint as maintenance_minutes, down as downtime_minutes,
      seen as observed_minutes, uptime_pct, {share("idle", "seen")} as idle_pct, load_pct as downtime_pct, {share("maint", "seen")} as maintenance_pct from uptime""",
    "fact_failure_natural": f"""with {_STAR_OBS} select event_id, event_date, {_TS.format(c="event_ts_utc")} as event_ts_utc, client_id, site_id, machine_id, model, fault_code, severity, severity_rank,
      downtime_minutes, maintenance_cost_gbp, part_code, part_quantity from failure_facts""",
    "star_unsettled_machines": f"with {_STAR_OBS} select distinct machine_id from unsettled",
    "star_unsettled_days": f"with {_STAR_OBS} select machine_id, event_date, attribute_sets, lacks_attribute from unsettled",
    "report_daily_uptime_by_site_model": f"""with {MARTS} select event_date, site_id, model, {two("avg(uptime_pct)")} as avg_uptime_pct, {_BIG("sum(down)", "attributed_downtime_minutes")},
      {two("avg(load_pct)")} as avg_downtime_load_pct, count_if(above) as attributed_downtime_above_observation_count, 'attributed_incident_v1' as downtime_semantics_version,
      {two("avg(health)")} as avg_health_score from uptime group by event_date, site_id, model""",
    "report_machine_observation_continuity": f"""with {MARTS}, d as (
        select client_id, site_id, machine_id, model, event_date, coalesce(run, 0) as run, seen,
          date_diff('day', lag(event_date) over (partition by client_id, site_id, machine_id, model order by event_date), event_date) as gap from uptime
      ), h as (select *, case when gap > 1 then gap - 1 else 0 end as hole from d),
      s as (
        select client_id, site_id, machine_id, model, min(event_date) as a, max(event_date) as z, count(*) as n, count_if(gap = 1) as pairs, count_if(hole > 0) as holes, sum(hole) as lost,
          max(hole) as most, avg(case when hole > 0 then hole end) as mean, count_if(seen <= 0) as unseen, count_if(run <= 0) as idle, sum(run) as run, sum(seen) as seen from h group by all
      )
      select client_id, site_id, machine_id, model, a as first_observed_date, z as last_observed_date, n as observed_day_count, cast(date_diff('day', a, z) + 1 as integer) as calendar_span_days,
        {share("n", "(date_diff('day', a, z) + 1)")} as observed_day_coverage_pct, pairs as consecutive_observation_pair_count, holes as observation_gap_count,
        cast(lost as bigint) as unobserved_days_within_span, cast(most as integer) as max_unobserved_gap_days, {two("mean")} as avg_unobserved_gap_days, unseen as no_observed_duration_day_count,
        idle as no_operating_time_day_count, {two("cast(run as double) / 60")} as operating_hours, {two("cast(seen as double) / 60")} as observed_hours,
        case when seen <= 0 then 'no_observed_duration' when n = 1 then 'single_observed_day' when holes = 0 then 'continuous_observed_dates' else 'intermittent_observed_dates' end as observation_continuity_status,
        'observed_date_span_only' as continuity_scope from s""",
    "report_client_asset_summary": f"""with {MARTS}, a as (
        select client_id, site_id, machine_id, model, {two("avg(uptime_pct)")} as avg_uptime_pct, {two("avg(health)")} as avg_health_score, {_BIG("sum(down)", "total_downtime_minutes")} from uptime group by all
      ), b as (select client_id, site_id, machine_id, count(*) as n, {two("sum(maintenance_cost_gbp)")} as cost from failures group by all)
      select a.*, coalesce(n, 0) as failure_event_count, coalesce(cost, 0.0) as failure_related_cost_gbp from a left join b using (client_id, site_id, machine_id)""",
    "report_machine_reliability_scorecard": f"""with {MARTS}, u as (
        select client_id, site_id, machine_id, model, min(event_date) as a, max(event_date) as z, sum(run) as run, sum(seen) as seen, sum(down) as down, {two("avg(uptime_pct)")} as up, {two("avg(health)")} as health from uptime group by all
      ), f as (
        select client_id, site_id, machine_id, model, count(*) as n, sum({_ALL_DOWN}) as lost, {two("sum(maintenance_cost_gbp)")} as cost, max(event_ts_utc) as latest from failures group by all
      )
      select u.client_id, u.site_id, u.machine_id, u.model, a as first_observed_date, z as last_observed_date, {two("cast(run as double) / 60")} as operating_hours, {two("cast(seen as double) / 60")} as observed_hours,
        up as avg_uptime_pct, health as avg_health_score, cast(down as bigint) as attributed_downtime_minutes, coalesce(n, 0) as failure_event_count,
        case when run > 0 then {two("coalesce(n, 0) * cast(6000 as double) / run")} end as failures_per_100_operating_hours, {ratio("lost", "n")} as avg_attributed_downtime_per_failure_minutes,
        {ratio("cost", "n")} as avg_failure_related_cost_gbp, coalesce(cost, 0.0) as failure_related_cost_gbp, {_TS.format(c="latest")} as latest_failure_at_utc,
        case when run <= 0 then 'no_operating_time' when coalesce(n, 0) = 0 then 'no_recorded_failures' else 'observed_failures' end as reliability_observation_status,
        'attributed_incident_v1' as downtime_semantics_version
      from u left join f on u.client_id = f.client_id and u.site_id = f.site_id and u.machine_id = f.machine_id and u.model is not distinct from f.model""",
    "report_monthly_reliability_trends": f"""with {MONTHLY}, m as (
        select *, {two("cast(run as double) / 60")} as h, {two("cast(seen as double) / 60")} as sh, {share("run", "seen")} as up, {two("cost")} as c2 from monthly
      ), p as (
        select *, lag(event_month) over w as pm, lag(up) over w as pu, lag(n) over w as pn, lag(down) over w as pd, lag(c2) over w as pc from m
        window w as (partition by client_id, site_id, model order by event_month)
      ), q as (select *, coalesce(pm + interval 1 month = event_month, false) as follows from p)
      select event_month, client_id, site_id, model, machines as observed_machine_count, h as operating_hours, sh as observed_hours, up as weighted_uptime_pct, health as avg_daily_machine_health_score,
        down as attributed_downtime_minutes, version as downtime_semantics_version, n as failure_event_count, affected as affected_machine_count, lost as failure_attributed_downtime_minutes,
        c2 as failure_related_cost_gbp, pm as previous_event_month,
        case when sh <= 0 then 'no_observed_duration' when pm is null then 'first_observed_month' when not follows then 'non_consecutive_history' else 'consecutive_comparison' end as trend_status,
        case when follows then {two("up - pu")} end as weighted_uptime_pct_change, case when follows then n - pn end as failure_event_count_change,
        case when follows then down - pd end as attributed_downtime_minutes_change, case when follows then {two("c2 - pc")} end as failure_related_cost_change_gbp from q""",
    "report_maintenance_cost_drivers": f"""with {MARTS}, p as (
        select cast(date_trunc('month', event_date) as date) as event_month, client_id, site_id, model, part_code, cast(sum(q) as bigint) as q, {two("sum(cost)")} as c from parts group by all
      ), t as (select * from p qualify row_number() over (partition by event_month, client_id, site_id, model order by q desc, c desc, part_code) = 1)
      select m.event_month, m.client_id, m.site_id, m.model, maint_n as maintenance_event_count, fail_n as failure_event_count, m.cost as maintenance_cost_gbp,
        coalesce(m.down, 0) as attributed_downtime_minutes, {ratio("m.cost", "maint_n")} as cost_per_maintenance_event_gbp, {ratio("m.cost", "fail_n")} as cost_per_failure_event_gbp,
        {ratio("coalesce(m.down, 0)", "fail_n")} as attributed_downtime_per_failure_minutes, t.part_code as top_recorded_part_code, t.q as top_recorded_part_quantity, t.c as top_recorded_part_cost_gbp,
        {share("t.c", "m.cost")} as top_recorded_part_cost_share_pct,
        case when maint_n = 0 and fail_n = 0 and m.cost = 0 and coalesce(m.down, 0) = 0 then 'no_recorded_maintenance_impact' when fail_n = 0 then 'maintenance_without_recorded_failure'
          when t.part_code is null then 'failure_without_recorded_part' else 'failure_with_recorded_part' end as maintenance_observation_status
      from costs m left join t on t.event_month = m.event_month and t.client_id = m.client_id and t.site_id = m.site_id and t.model is not distinct from m.model""",
    "report_site_reliability_benchmark": f"""with {MONTHLY}, b as (
        select *, sum(run) over w as a_run, sum(seen) over w as a_seen, sum(n) over w as a_n, sum(cost) over w as a_cost, count(*) over w as k, count_if(seen > 0) over w as k_seen, count_if(run > 0) over w as k_run
        from monthly window w as (partition by event_month, client_id, model)
      ), r as (
        select *, {share("run", "seen")} as up, {share("a_run", "a_seen")} as a_up, case when run > 0 then {two("n * cast(6000 as double) / run")} end as fr,
          case when a_run > 0 then {two("a_n * cast(6000 as double) / a_run")} end as a_fr, case when run > 0 then {two("cost * 60 / run")} end as cr, case when a_run > 0 then {two("a_cost * 60 / a_run")} end as a_cr from b
      )
      select event_month, client_id, site_id, model, machines as observed_machine_count, {two("cast(run as double) / 60")} as operating_hours, {two("cast(seen as double) / 60")} as observed_hours,
        up as weighted_uptime_pct, a_up as client_model_weighted_uptime_pct, {two("up - a_up")} as weighted_uptime_pct_vs_client_model, n as failure_event_count, affected as affected_machine_count,
        fr as failure_events_per_100_operating_hours, a_fr as client_model_failure_events_per_100_operating_hours, {two("fr - a_fr")} as failure_rate_vs_client_model, {two("cost")} as failure_related_cost_gbp,
        cr as failure_related_cost_per_operating_hour_gbp, a_cr as client_model_failure_related_cost_per_operating_hour_gbp, {two("cr - a_cr")} as cost_rate_vs_client_model_gbp, down as attributed_downtime_minutes,
        lost as failure_attributed_downtime_minutes, version as downtime_semantics_version, k as benchmark_site_row_count, k_seen as comparable_observed_site_count, k_run as comparable_operating_site_count,
        cast(row_number() over (partition by event_month, client_id, model order by up desc nulls last, fr asc nulls last, cr asc nulls last, site_id) as integer) as site_comparison_rank,
        case when seen <= 0 then 'site_has_no_observed_duration' when run <= 0 then 'site_has_no_operating_time' when k_seen < 2 then 'single_observed_site_reference' else 'multi_site_comparison' end as benchmark_status
      from r""",
    "report_failure_events_by_fault": f"""with {_STAR_OBS} select event_date, {_FK}, count(*) as failure_event_count, count(distinct machine_id) as affected_machine_count,
      cast(sum(downtime_minutes) as bigint) as downtime_minutes, {two("sum(maintenance_cost_gbp)")} as maintenance_cost_gbp from failure_facts group by event_date, {_FK}""",
    "report_machine_fault_recurrence": f"""with {_STAR_OBS}, {_recurrence("failure_facts", _R_KEYS, f"cast(sum({_ALL_DOWN}) as bigint) as down, {two('sum(maintenance_cost_gbp)')} as cost")}
      select {_R_KEYS}, cast(row_number() over (partition by client_id, site_id, model order by n desc, days desc, down desc, cost desc, severity_rank desc, machine_id, fault_code, severity) as integer) as observed_recurrence_rank,
        first as first_observed_failure_date, latest as latest_observed_failure_date, {_TS.format(c="first_at")} as first_observed_failure_at_utc, {_TS.format(c="latest_at")} as latest_observed_failure_at_utc,
        n as observed_failure_event_count, ids as observed_failure_identity_count, n - 1 as repeat_observed_failure_event_count, days as observed_failure_day_count, months as observed_failure_month_count,
        cast(date_diff('day', first, latest) + 1 as integer) as observed_failure_calendar_span_days, intervals as recurrence_interval_observation_count, cast(min_gap as integer) as min_days_between_observed_failure_days,
        {two("avg_gap")} as avg_days_between_observed_failure_days, cast(max_gap as integer) as max_days_between_observed_failure_days, down as attributed_downtime_minutes, cost as failure_related_cost_gbp,
        {ratio("down", "n")} as avg_attributed_downtime_per_failure_event_minutes, {ratio("cost", "n")} as avg_failure_related_cost_per_event_gbp, {_repeat("failure", "")} as observed_recurrence_status,
        'observed_failure_events_only' as recurrence_scope from r""",
    "report_machine_part_usage_recurrence": f"""with {_STAR_OBS}, used as (select * from failure_facts where part_code <> 'NONE' and part_quantity > 0),
      {_recurrence("used", _R_KEYS + ", part_code", f"cast(sum(part_quantity) as bigint) as q, cast(sum({_ALL_DOWN}) as bigint) as down, {two('sum(maintenance_cost_gbp)')} as cost")}
      select {_R_KEYS}, part_code, cast(row_number() over (partition by client_id, site_id, model order by q desc, n desc, cost desc, severity_rank desc, machine_id, fault_code, part_code, severity) as integer) as observed_part_usage_rank,
        first as first_observed_part_use_date, latest as latest_observed_part_use_date, {_TS.format(c="first_at")} as first_observed_part_use_at_utc, {_TS.format(c="latest_at")} as latest_observed_part_use_at_utc,
        n as observed_part_event_count, ids as observed_part_identity_count, n - 1 as repeat_observed_part_event_count, days as observed_part_day_count, months as observed_part_month_count,
        cast(date_diff('day', first, latest) + 1 as integer) as observed_part_use_calendar_span_days, intervals as recurrence_interval_observation_count, cast(min_gap as integer) as min_days_between_observed_part_use_dates,
        {two("avg_gap")} as avg_days_between_observed_part_use_dates, cast(max_gap as integer) as max_days_between_observed_part_use_dates, q as total_recorded_part_quantity,
        {ratio("q", "n")} as avg_recorded_part_quantity_per_event, down as associated_attributed_downtime_minutes, {ratio("down", "n")} as avg_associated_downtime_per_part_event_minutes, cost as associated_failure_cost_gbp,
        {ratio("cost", "n")} as avg_associated_failure_cost_per_part_event_gbp, {_repeat("part", "part_")} as part_usage_recurrence_status, 'observed_failure_part_records_only' as part_usage_scope from r""",
    "report_monthly_part_usage_concentration": f"""with {_STAR_OBS}, p as (
        select cast(date_trunc('month', event_date) as date) as event_month, client_id, site_id, model, part_code, count(*) as observed_part_event_count, count(distinct event_id) as observed_part_identity_count,
          count(distinct machine_id) as machines, count(distinct event_date) as observed_part_day_count, count(distinct row(fault_code, severity)) as associated_fault_count, cast(sum(part_quantity) as bigint) as recorded_part_quantity,
          cast(sum({_ALL_DOWN}) as bigint) as associated_attributed_downtime_minutes, {two("sum(maintenance_cost_gbp)")} as associated_failure_cost_gbp
        from failure_facts where part_code <> 'NONE' and part_quantity > 0 group by all
      ), s as (
        select * exclude (machines), machines as affected_machine_count, {_shares({"recorded_part_quantity": "recorded_part_quantity", "observed_part_event_count": "observed_part_event", "associated_attributed_downtime_minutes": "associated_attributed_downtime", "associated_failure_cost_gbp": "associated_failure_cost"}, _PART_ORDER)},
          cast(row_number() over (partition by event_month, client_id, site_id, model order by {_PART_ORDER}) as integer) as part_usage_rank, count(*) over (partition by event_month, client_id, site_id, model) as recorded_part_count from p
      )
      select *, case when total_associated_attributed_downtime_minutes <= 0 and total_associated_failure_cost_gbp <= 0 then 'part_quantity_without_recorded_impact'
        when total_associated_failure_cost_gbp <= 0 then 'part_quantity_without_recorded_cost' else 'part_usage_evidence_observed' end as part_usage_evidence_status, 'observed_failure_part_records_only' as part_usage_scope from s""",
    "report_fault_impact_concentration": f"""with {_STAR_OBS}, p as (
        select cast(date_trunc('month', event_date) as date) as event_month, {_FK}, count(*) as failure_event_count, count(distinct machine_id) as affected_machine_count,
          cast(sum({_ALL_DOWN}) as bigint) as attributed_downtime_minutes, {two("sum(maintenance_cost_gbp)")} as maintenance_cost_gbp from failure_facts group by all
      ), s as (
        select *, {_shares({"failure_event_count": "failure_event", "attributed_downtime_minutes": "attributed_downtime", "maintenance_cost_gbp": "maintenance_cost"}, _FAULT_ORDER)},
          cast(row_number() over (partition by event_month, client_id, site_id, model order by {_FAULT_ORDER}) as integer) as fault_impact_rank from p
      )
      select *, case when total_failure_event_count <= 0 then 'no_recorded_failures' when total_attributed_downtime_minutes <= 0 and total_maintenance_cost_gbp <= 0 then 'failures_without_recorded_impact'
        when total_maintenance_cost_gbp <= 0 then 'failures_without_recorded_cost' else 'failure_impact_observed' end as impact_evidence_status from s""",
    "report_costliest_failures": f"with {MARTS} select event_date, site_id, client_id, machine_id, model, fault_code, severity, downtime_minutes, maintenance_cost_gbp, event_id from failures",
    "report_maintenance_cost_by_month_model": f"""with {MARTS} select event_month, site_id, model, cast(sum(maint_n) as bigint) as maintenance_events, cast(sum(fail_n) as bigint) as failure_events,
      {two("sum(cost)")} as maintenance_cost_gbp, cast(sum(down) as bigint) as downtime_minutes from costs group by event_month, site_id, model""",
    "report_parts_usage_by_site": f"""with {MARTS} select event_date, site_id, part_code, cast(sum(q) as bigint) as part_quantity, {two("sum(cost)")} as associated_cost_gbp,
      cast(sum(machines) as bigint) as impacted_machine_count from parts group by event_date, site_id, part_code""",
}
_SEG = "site_id, client_id, model"


DAILY = (
    MARTS
    + f""",
daily as (
  select event_date, {_SEG}, {_BIG("sum(down)", "actual")}, count(distinct machine_id) as machines, {two("avg(uptime_pct)")} as up, {two("avg(health)")} as health from uptime group by all
),
past as (
  select *, {two("avg(actual) over w")} as guess, count(*) over w as history, min(event_date) over w as since from daily
  window w as (partition by {_SEG} order by event_date range between interval 28 days preceding and interval 1 day preceding)
),
e as (
  select *, {two("abs(actual - guess)")} as ae, (actual - guess) * (actual - guess) as se, case when actual > 0 then abs(actual - guess) / actual end as ape, {two("(actual - guess)")} as res
  from past where history > 0
),
padded as (
  select *, case when model is null then 0.0 else coalesce({two("stddev_samp(res) over s")}, {two("avg(ae) over s")}) end as pad from e window s as (partition by {_SEG})
),
v as (
  select *, greatest(0.0, {two("(guess - pad)")}) as lo, {two("guess + pad")} as hi from padded
),
validated as (select *, actual >= lo and actual <= hi as covered from v)
"""
)
_PCT = "avg(case when covered then 1.0::double else 0.0::double end) * 100"
SQL["ingestion_coverage"] = """with b as (
  select cast(_ingested_at at time zone 'UTC' as date) as d, regexp_extract(_source_file, '([^/]+)$', 1) as name from sample_machine_events
), i as (
  select *, regexp_extract(name, '^machine-events__(incremental|backfill)(?:__replay_([A-Za-z0-9._-]{1,64}))?__sha256_([0-9a-f]{64})[.]csv$', 1) as mode,
    regexp_extract(name, '^machine-events__(incremental|backfill)(?:__replay_([A-Za-z0-9._-]{1,64}))?__sha256_([0-9a-f]{64})[.]csv$', 2) as replay from b
)
select d as ingestion_date, case when mode <> '' then mode else 'invalid' end as ingestion_mode, count(*) as row_count, count(distinct name) as source_object_count,
  count_if(not ((mode = 'incremental' and replay = '') or (mode = 'backfill' and replay <> ''))) as invalid_source_identity_row_count,
  count(distinct case when mode = 'backfill' then replay end) as replay_id_count from i group by all"""
SQL["forecast_validation"] = f"""with {DAILY} select event_date, {_SEG}, machines as machine_count, actual as actual_downtime_minutes, guess as forecast_downtime_minutes, history as history_day_count,
  since as history_start_date, cast(date_diff('day', since, event_date) as integer) as history_calendar_span_days, ae as absolute_error_minutes, se as squared_error_minutes, ape as absolute_percentage_error,
  res as residual_minutes, lo as validation_interval_lower_minutes, hi as validation_interval_upper_minutes, covered as covered_by_validation_interval, 'run-1' as forecast_run_id,
  '2026-04-01T00:00:00Z' as validation_generated_at, 'calendar_rolling_mean' as model_name, 'prior_calendar_days' as window_semantics, 28 as baseline_window_days from validated"""
SQL["forecast_downtime"] = f"""with {DAILY}, l as (select *, max(event_date) over (partition by {_SEG}) as latest from daily where model is not null),
  n as (
    select {_SEG}, latest, min(event_date) as since, count(*) as days, {two("avg(actual)")} as guess, {two("avg(up)")} as up, {two("avg(health)")} as health, max(machines) as machines
    from l where event_date > latest - 28 group by all
  ),
  m as (
    select {_SEG}, count(*) as k, {two("avg(ae)")} as mae, {two("sqrt(avg(se))")} as rmse, {two("avg(ape) * 100")} as mape, {two("stddev_samp(res)")} as sd, max(event_date) as last_v, {two(_PCT)} as cov
    from validated group by all
  ),
  j as (select n.*, coalesce(k, 0) as k, mae, rmse, mape, last_v, cov, coalesce(sd, mae, 0.0) as pad from n left join m using (site_id, client_id, model))
  select 'run-1' as forecast_run_id, '2026-04-01T00:00:00Z' as forecast_generated_at, latest + 7 as forecast_date, latest as latest_actual_date, 'calendar_rolling_mean' as model_name,
    'prior_calendar_days' as window_semantics, 28 as baseline_window_days, 7 as forecast_horizon_days, 14 as min_validation_observations, {_SEG}, machines as machine_count, guess as forecast_downtime_minutes,
    greatest(0.0, {two("(guess - pad)")}) as prediction_interval_lower_minutes, {two("guess + pad")} as prediction_interval_upper_minutes, up as recent_avg_uptime_pct, health as recent_avg_health_score,
    days as forecast_history_day_count, since as forecast_history_start_date, cast(date_diff('day', since, latest) + 1 as integer) as forecast_history_calendar_span_days, k as validation_observation_count,
    mae as mae_downtime_minutes, rmse as rmse_downtime_minutes, mape as mape_pct, cov as backtest_interval_coverage_pct, last_v as latest_validation_date, true as thresholds_configured,
    60.0::double as max_mae_downtime_minutes, 60.0::double as min_interval_coverage_pct, k >= 14 as meets_min_validation_samples, coalesce(mae <= 60, false) as meets_mae_threshold,
    coalesce(cov >= 60, false) as meets_interval_coverage_threshold,
    case when k < 14 then 'insufficient_validation_history' when coalesce(mae <= 60 and cov >= 60, false) then 'validated_baseline' else 'accuracy_threshold_failed' end as forecast_status from j"""
SQL["forecast_diagnostics"] = f"""with {DAILY}, w as (select * from validated qualify row_number() over (partition by {_SEG} order by ae desc, event_date desc) = 1),
  m as (
    select {_SEG}, count(*) as k, min(event_date) as a, max(event_date) as z, {two("avg(actual)")} as aa, {two("avg(guess)")} as ag, {two("avg(res)")} as me, {two("avg(ae)")} as mae, {two("sqrt(avg(se))")} as rmse,
      count(ape) as pk, {two("avg(ape) * 100")} as mape, {two(_PCT)} as cov, count_if(res > 0) as u, count_if(res < 0) as o, count_if(res = 0) as x from validated group by all
  )
  select 'run-1' as forecast_run_id, 'calendar_rolling_mean' as model_name, 'prior_calendar_days' as window_semantics, 28 as baseline_window_days, m.client_id, m.site_id, m.model,
    '2026-04-01T00:00:00Z' as validation_generated_at, k as validation_observation_count, a as first_validation_date, z as latest_validation_date, aa as avg_actual_downtime_minutes, ag as avg_forecast_downtime_minutes,
    me as mean_error_minutes, mae as mae_downtime_minutes, rmse as rmse_downtime_minutes, pk as percentage_error_observation_count, m.mape as mape_pct, cov as validation_interval_coverage_pct,
    u as under_forecast_observation_count, o as over_forecast_observation_count, x as exact_forecast_observation_count,
    case when mae = 0 then 'exact_validation_observations' when me > 0 then 'under_forecast_bias_observed' when me < 0 then 'over_forecast_bias_observed' else 'balanced_mean_error' end as validation_bias_status,
    w.event_date as largest_absolute_error_date, w.machines as largest_error_machine_count, w.actual as largest_error_actual_downtime_minutes, w.guess as largest_error_forecast_downtime_minutes,
    w.ae as largest_absolute_error_minutes, w.res as largest_error_residual_minutes, w.history as largest_error_history_day_count, w.since as largest_error_history_start_date,
    cast(date_diff('day', w.since, w.event_date) as integer) as largest_error_history_calendar_span_days, w.lo as largest_error_interval_lower_minutes, w.hi as largest_error_interval_upper_minutes,
    w.covered as largest_error_covered_by_interval
  from m join w on m.site_id = w.site_id and m.client_id = w.client_id and m.model is not distinct from w.model"""
_E_SILVER = {
    **{f"{c}_present": f"trim({c}, ' ') <> ''" for c in ("event_id", "machine_id", "site_id", "client_id")},
    "event_timestamp_present": "event_ts_utc is not null",
    **{n: f"{c} is null or {c} >= 0" for n, c in (("duration_non_negative", "duration_minutes"), ("downtime_non_negative", "downtime_minutes"), ("maintenance_cost_non_negative", "maintenance_cost_gbp"))},
    **{n: f"{c} is null or {c} between 0 and 100" for n, c in (("fuel_level_in_range", "fuel_level_pct"), ("health_score_in_range", "health_score"))},
}
_E_UPTIME = {
    "event_date_present": "event_date is not null",
    **{f"{c}_present": f"trim({c}, ' ') <> ''" for c in ("machine_id", "site_id")},
    "duration_values_present": "run is not null and idle is not null and maint is not null and down is not null and seen is not null",
    "duration_values_non_negative": "run >= 0 and idle >= 0 and maint >= 0 and down >= 0 and seen >= 0",
    "status_minutes_within_observed": "coalesce(run, 0) + coalesce(idle, 0) + coalesce(maint, 0) <= coalesce(seen, 0)",
    "uptime_pct_in_range": "uptime_pct is null or uptime_pct between 0 and 100",
    "avg_health_score_in_range": "health is null or health between 0 and 100",
    "downtime_load_formula_valid": "(seen > 0 and load_pct is not null and abs(load_pct - down / seen * 100) <= 0.0151) or (seen = 0 and down = 0 and load_pct = 0) or (seen = 0 and down > 0 and load_pct is null)",
    "downtime_compatibility_alias_consistent": "true",
    "downtime_exceedance_flag_consistent": "above is not distinct from (down > seen)",
    "downtime_semantics_version_known": "true",
}


def _expect(cte: str, table: str, rules: dict[str, str]) -> str:
    one = lambda n, p: f"select '{table}' as dataset, '{n}' as expectation, count(case when {p} then 1 end) as passed_records, count(*) - count(case when {p} then 1 end) as failed_records from {table}"
    return f"with {cte} " + " union all ".join(one(n, p) for n, p in rules.items())


SQL["expectations_silver"] = _expect(SILVER, "silver", _E_SILVER)
SQL["expectations_uptime"] = _expect(MARTS, "uptime", _E_UPTIME)


_CHAINS = f"""{_USABLE},
days as (select distinct event_date, machine_id, client_id, site_id, model from usable where machine_id not in (select machine_id from disputed)),
steps as (select *, lag(row(client_id, site_id, model)) over (partition by machine_id order by event_date) as before from days),
chains as (
  select machine_id, event_date as effective_from, lead(event_date) over w - 1 as effective_to, lead(event_date) over w is null as is_current, cast(row_number() over w as integer) as version, client_id, site_id, model
  from steps where before is null or before <> row(client_id, site_id, model) window w as (partition by machine_id order by event_date)
)
"""
SQL["assignment_history"] = f"""with {_CHAINS}, s as (
  select event_date, trim(machine_id, ' ') as machine_id, count(distinct nullif(trim(assignment_evidence_source, ' '), '')) as n from machine_assignments
  where event_date is not null and {" and ".join(f"trim(coalesce({c}, ''), ' ') <> ''" for c in ("machine_id", "client_id", "site_id", "model"))} group by all
)
select c.*, cast(coalesce(sum(n), 0) as bigint) as assignment_evidence_source_count from chains c
left join s on s.machine_id = c.machine_id and s.event_date >= c.effective_from and (c.effective_to is null or s.event_date <= c.effective_to) group by all"""
SQL["assignment_resolution"] = f"""with {SILVER}, {_CHAINS}
select event_id, s.machine_id, event_date, case when c.machine_id is null then 'unresolved' else 'resolved' end as resolution_status, case when c.machine_id is null then 0 else 1 end as match_count,
  c.client_id as resolved_client_id, c.site_id as resolved_site_id, c.model as resolved_model
from silver s left join chains c on c.machine_id = s.machine_id and s.event_date >= c.effective_from and (c.effective_to is null or s.event_date <= c.effective_to)"""
SQL["assignment_audit"] = """select unnest(['assignment_history_grain_duplicate', 'assignment_history_identity_missing', 'assignment_history_range_overlap',
  'assignment_history_current_member_invalid', 'assignment_history_range_invalid']) as finding, cast(0 as bigint) as observed_count"""


def _conforms() -> str:
    there = lambda c: f"trim(coalesce({c}, ''), ' ') <> ''"
    whole_number = lambda c: f"regexp_full_match(coalesce({c}, ''), '0|[1-9][0-9]*')"
    rules = {("required_key_missing", c): f"not ({there(c)})" for c in ("event_id", "machine_id", "event_ts", "site_id", "client_id")}
    utc = TS_SHAPE.replace("(Z|[+-][0-9]{2}:[0-9]{2})", "Z")
    rules["utc_timestamp_invalid", "event_ts"] = f"{there('event_ts')} and not (regexp_full_match(event_ts, '{utc}') and try_cast(substr(event_ts, 1, 10) as date) is not null)"
    for c in ("hour_meter", "temperature_c", "vibration_mm_s", "fuel_level_pct", "maintenance_cost_gbp"):
        rules["decimal_invalid", c] = f"{there(c)} and {_num(c)} is null"
    for c in ("duration_minutes", "downtime_minutes", "part_quantity"):
        rules["integer_format_invalid", c] = f"{there(c)} and not {whole_number(c)}"
        rules["integer_range_violation", c] = f"{whole_number(c)} and try_cast({c} as hugeint) > 2147483647"
    for c in ("hour_meter", "vibration_mm_s", "maintenance_cost_gbp"):
        rules["non_negative_violation", c] = f"{_num(c)} < 0"
    rules["fuel_range_violation", "fuel_level_pct"] = f"{_num('fuel_level_pct')} < 0 or {_num('fuel_level_pct')} > 100"
    parts = [f"select '{code}' as code, '{column}' as column, count_if({p}) as observed_count from sample_machine_events" for (code, column), p in rules.items()]
    same = f"select count(*) as n, count(distinct row({_RAW})) as k from sample_machine_events where {there('event_id')} group by event_id having count(*) > 1"
    for code, when in (("replay_duplicate", "k = 1"), ("conflicting_duplicate", "k > 1")):
        parts.append(f"select '{code}', 'event_id', cast(coalesce(sum(case when {when} then n - 1 end), 0) as bigint) from ({same})")
    return "select * from (" + " union all ".join(parts) + ") where observed_count > 0"


SQL["landing_conformance"] = _conforms()


def _counting(sql: str) -> str:
    """count_if gives a huge int; count over a case gives a bigint."""
    while (a := sql.find("count_if(")) >= 0:
        depth, z = 1, a + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[z], 0)
            z += 1
        sql = f"{sql[:a]}count(case when {sql[a + len('count_if('):z - 1]} then 1 end){sql[z:]}"
    return sql


#: The payload's digest is over Spark's own JSON; it is tested apart, and left out of the comparison.
SQL["silver_events"] = f"""with {SILVER} select event_id, machine_id, site_id, client_id, model, hour_meter, event_type, status, fault_code, severity, temperature_c, vibration_mm_s, fuel_level_pct,
  duration_minutes, downtime_minutes, maintenance_cost_gbp, part_code, part_quantity, operator_shift, strftime(_ingested_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as _ingested_at, _source_file,
  {_TS.format(c="event_ts_utc")} as event_ts_utc, event_date, is_failure_event, health_score from silver"""
SQL = {name: _counting(sql) for name, sql in SQL.items()}
