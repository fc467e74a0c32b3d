"""The same results as plain SQL, run by DuckDB beside the operators."""

NUM = r"(case when regexp_full_match(trim({c}, ' '), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim({c}, ' ') as double) end)"
TS_SHAPE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-][0-9]{2}:[0-9]{2})"


def _num(c: str) -> str:
    return NUM.replace("{c}", c)


def _epoch(c: str) -> str:
    t = f"trim({c}, ' ')"
    part = lambda a: f"coalesce(try_cast(substr({t}, {a}, 2) as bigint), 0)"
    local = f"cast(epoch(try_cast(substr({t}, 1, 10) as date)) as bigint) + {part(12)} * 3600 + {part(15)} * 60 + {part(18)}"
    shift = f"(case substr({t}, 20, 1) when '+' then -1 when '-' then 1 else 0 end) * ({part(21)} * 3600 + {part(24)} * 60)"
    return f"(case when regexp_full_match({t}, '{TS_SHAPE}') then {local} + {shift} end)"


def _same(c: str, read: str | None = None) -> str:
    text = f"coalesce(lower(trim({c}, ' ')), '')"
    return f"coalesce(cast({read} as varchar), {text})" if read else text


_NUMBERS = ("hour_meter", "temperature_c", "vibration_mm_s", "fuel_level_pct", "duration_minutes", "downtime_minutes", "maintenance_cost_gbp", "part_quantity")
_TEXTS = ("machine_id", "site_id", "client_id", "model", "event_type", "status", "fault_code", "severity", "part_code", "operator_shift")
_VALUES = ", ".join([_same("event_ts", _epoch("event_ts")), *[_same(c, _num(c) + " + 0.0") for c in _NUMBERS], *[_same(c) for c in _TEXTS]])

LANDED = f"""
landed as (
  select *, trim(event_id, ' ') as id, row({_VALUES}) as payload from sample_machine_events where trim(coalesce(event_id, ''), ' ') <> ''
),
agreeing as (select id from landed group by id having count(distinct payload) = 1)
"""
TRUSTED = (
    LANDED
    + f""",
trusted as (
  select id as event_id, trim(machine_id, ' ') as machine_id, {_epoch("event_ts")} as epoch_s, trim(site_id, ' ') as site_id,
         coalesce({_num("duration_minutes")}, 0) as duration_minutes, coalesce({_num("downtime_minutes")}, 0) as downtime_minutes
  from landed join agreeing using (id) where {_epoch("event_ts")} is not null and trim(coalesce(machine_id, ''), ' ') <> ''
  qualify row_number() over (partition by id order by _ingested_at desc, record_id desc) = 1
)
"""
)

P1 = f"""
with {TRUSTED},
spans as (
  select 'down' as kind, machine_id, epoch_s as s, epoch_s + cast(downtime_minutes * 60 as bigint) as e from trusted where downtime_minutes > 0
  union all
  select 'report', machine_id, epoch_s, epoch_s + cast(duration_minutes * 60 as bigint) from trusted where duration_minutes > 0
),
marked as (
  select *, case when s <= max(e) over (partition by kind, machine_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from spans
),
islands as (select *, sum(fresh) over (partition by kind, machine_id order by s, e rows unbounded preceding) as island from marked),
periods as (select kind, machine_id, min(s) as s, max(e) as e from islands group by kind, machine_id, island),
holes as (select kind, machine_id, e as s, lead(s) over (partition by kind, machine_id order by s) as e from periods)
select kind, machine_id, cast(s as bigint) as start_s, cast(e as bigint) as end_s from periods where kind = 'down'
union all
select 'gap', machine_id, cast(s as bigint), cast(e as bigint) from holes where kind = 'report' and e - s <= 7 * 86400
"""

P3 = f"""
with {LANDED}
select id as event_id, record_id from landed join agreeing using (id)
qualify row_number() over (partition by id order by _ingested_at desc, record_id desc) > 1
"""

_USABLE = """
usable as (
  select cast(event_date as date) as event_date, trim(machine_id, ' ') as machine_id, trim(client_id, ' ') as client_id,
         trim(site_id, ' ') as site_id, trim(model, ' ') as model, _ingested_at
  from machine_assignments
  where event_date is not null and trim(coalesce(machine_id, ''), ' ') <> '' and trim(coalesce(client_id, ''), ' ') <> ''
    and trim(coalesce(site_id, ''), ' ') <> '' and trim(coalesce(model, ''), ' ') <> ''
),
disputed as (
  select distinct machine_id from (select machine_id from usable group by machine_id, event_date having count(distinct row(client_id, site_id, model)) > 1)
)
"""

P4 = f"""
with {_USABLE},
days as (select distinct event_date, machine_id, client_id, site_id, model from usable where machine_id not in (select machine_id from disputed)),
steps as (select *, lag(row(client_id, site_id, model)) over (partition by machine_id order by event_date) as before from days)
select machine_id, cast(event_date as varchar) as effective_from, client_id, site_id, model
from steps where before is null or before <> row(client_id, site_id, model)
"""

P5 = f"""
with {TRUSTED}, {_USABLE},
known as (
  select t.event_id, t.site_id as own, u.site_id
  from trusted t join usable u on u.machine_id = t.machine_id
    and epoch(u.event_date) <= t.epoch_s and epoch_us(u._ingested_at) <= t.epoch_s * 1000000
  where t.machine_id not in (select machine_id from disputed)
  qualify row_number() over (partition by t.event_id order by u.event_date desc) = 1
)
select event_id, site_id from known where coalesce(own, '') <> site_id
"""

_QUOTING = r"""([^",]*|"[^"]*(""[^"]*)*")(,([^",]*|"[^"]*(""[^"]*)*"))*"""
_COUNT = r"""([^",]*|"[^"]*(""[^"]*)*")(,([^",]*|"[^"]*(""[^"]*)*")){19}"""
_FIELDS = r"""[f[2:] for f in regexp_extract_all(',' || raw_line, '(?s),("[^"]*(?:""[^"]*)*"|[^",]*)')]"""


def _reads(ts: str, hm: str, tc: str) -> str:
    missing = lambda c: f"trim(coalesce({c}, ''), ' ') = ''"
    bad = lambda c: f"not ({missing(c)}) and {_num(c)} is null"
    return f"case when {_epoch(ts)} is null then 'event_ts' when {bad(hm)} then 'hour_meter' when {bad(tc)} then 'temperature_c' end"


P6 = f"""
with split as (
  select record_id, raw_line, regexp_full_match(raw_line, '(?s){_QUOTING}') as quoted, regexp_full_match(raw_line, '(?s){_COUNT}') as whole,
         [case when f[1:1] = '"' then f[2:-2] else f end for f in {_FIELDS}] as f
  from landed_lines
),
judged as (
  select record_id, case when not quoted then 'quoting' when not whole then 'column_count' else {_reads("f[3]", "f[7]", "f[12]")} end as reason from split
  union all
  select record_id, {_reads("event_ts", "hour_meter", "temperature_c")} from sample_machine_events
)
select record_id, reason from judged where reason is not null
"""

_COLUMNS = (
    "event_id", "machine_id", "event_ts", "site_id", "client_id", "model", "hour_meter", "event_type", "status", "fault_code", "severity", "temperature_c", "vibration_mm_s", "fuel_level_pct",
    "duration_minutes", "downtime_minutes", "maintenance_cost_gbp", "part_code", "part_quantity", "operator_shift",
)


def _typed(get) -> str:
    text = lambda c: f"nullif(trim({c}, ' '), '')"
    instant = lambda c: f"strftime(make_timestamp({_epoch(c)} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
    read = {c: instant(get(c)) if c == "event_ts" else f"{_num(get(c))} + 0.0" if c in _NUMBERS else text(get(c)) for c in _COLUMNS}
    unread = ", ".join(f"case when {text(get(c))} is not null and {_num(get(c))} is null then '{c}' end" for c in _COLUMNS if c in _NUMBERS)
    return ", ".join(f"{x} as {c}" for c, x in read.items()) + f", nullif(concat_ws(',', {unread}), '') as unread_columns"


P6_LOADED = f"""
with split as (
  select record_id, regexp_full_match(raw_line, '(?s){_QUOTING}') and regexp_full_match(raw_line, '(?s){_COUNT}') as whole,
         [case when f[1:1] = '"' then replace(f[2:-2], '""', '"') else f end for f in {_FIELDS}] as f
  from landed_lines
)
select record_id, {_typed(lambda c: f"f[{_COLUMNS.index(c) + 1}]")} from split where whole and {_reads("f[3]", "f[7]", "f[12]")} is null
union all
select record_id, {_typed(lambda c: c)} from sample_machine_events where {_reads("event_ts", "hour_meter", "temperature_c")} is null
"""

_ROLLING = f"""
with {TRUSTED},
daily as (select machine_id, cast(floor(epoch_s / 86400) as bigint) as d, sum(downtime_minutes) as m from trusted group by all),
days as (select machine_id, unnest(generate_series(min(d), max(d))) as d from daily group by machine_id),
totals as (
  select machine_id, d,
         sum(coalesce(m, 0)) over (partition by machine_id order by d rows between 6 preceding and current row) as t7,
         sum(coalesce(m, 0)) over (partition by machine_id order by d rows between 29 preceding and current row) as t30
  from days left join daily using (machine_id, d)
)
"""
P7 = _ROLLING + "select machine_id, cast(date '1970-01-01' + cast(d as integer) as varchar) as activity_day from totals where t7 >= 360 and t7 * 2 >= t30"
P7_TOTALS = (
    _ROLLING
    + """select machine_id, cast(date '1970-01-01' + cast(d as integer) as varchar) as activity_day, cast(t7 as double) as total_7d,
cast(t30 as double) as total_30d, cast(t7 as double) / 7 as avg_7d, cast(t30 as double) / 30 as avg_30d from totals"""
)

SQL = {"p1_found": P1, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p6_found": P6, "p6_loaded": P6_LOADED, "p7_found": P7, "p7_totals": P7_TOTALS}
