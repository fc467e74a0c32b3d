"""How landed records conform to the strict landing contract: one row of counts per code and column, from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.contracts import EVENT_COLUMNS
from quarrylake.functions.reading import NUMBER, existing_date, whole

#: Columns by what the contract asks of them.
KEYS = ("event_id", "machine_id", "event_ts", "site_id", "client_id")
DECIMALS = ("hour_meter", "temperature_c", "vibration_mm_s", "fuel_level_pct", "maintenance_cost_gbp")
INTEGERS = ("duration_minutes", "downtime_minutes", "part_quantity")
NON_NEGATIVE = ("hour_meter", "vibration_mm_s", "maintenance_cost_gbp")
UTC = rf"{existing_date()}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z"


def rules() -> dict[tuple[str, str], Column]:
    """What breaks the contract in a record, by (code, column).

    required_key_missing: NULL, empty or blank. utc_timestamp_invalid: not an existing UTC instant ending in Z.
    decimal_invalid, integer_format_invalid: present, but not a number, or not a whole one in its shortest form.
    integer_range_violation: beyond a 32-bit int. non_negative_violation, fuel_range_violation: bounds of what reads.
    """
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in EVENT_COLUMNS}
    there = {c: t != "" for c, t in text.items()}
    number = {c: F.when(text[c].rlike(whole(NUMBER)), text[c].try_cast("double")) for c in DECIMALS}
    canonical = {c: F.col(c).rlike(r"\A(?:0|[1-9][0-9]*+)\z") for c in INTEGERS}
    out = {("required_key_missing", c): ~there[c] for c in KEYS}
    out["utc_timestamp_invalid", "event_ts"] = there["event_ts"] & ~F.col("event_ts").rlike(whole(UTC))
    out |= {("decimal_invalid", c): there[c] & number[c].isNull() for c in DECIMALS}
    out |= {("integer_format_invalid", c): there[c] & ~canonical[c] for c in INTEGERS}
    out |= {("integer_range_violation", c): canonical[c] & ((F.length(c) > 10) | (F.col(c).try_cast("bigint") > 2_147_483_647)) for c in INTEGERS}
    out |= {("non_negative_violation", c): number[c] < 0 for c in NON_NEGATIVE}
    out["fuel_range_violation", "fuel_level_pct"] = (number["fuel_level_pct"] < 0) | (number["fuel_level_pct"] > 100)
    return out


def violations(events: DataFrame, *keep: str) -> DataFrame:
    """keep, code and column of each rule that a record breaks: a row per breach."""
    each = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(column).alias("column"))) for (code, column), when in rules().items()]))
    return events.select(*keep, F.explode(each).alias("_v")).select(*keep, "_v.code", "_v.column")


def findings(events: DataFrame) -> DataFrame:
    """code, column, observed_count of what doesn't conform, see rules. Counts of 0 are not listed.

    replay_duplicate, conflicting_duplicate (column event_id): further records of an id with equal, or with any other
    payload; ids are combined before the shuffle.
    """
    broken = rules()
    one = events.agg(*[F.count_if(p).alias(f"{code}:{column}") for (code, column), p in broken.items()])
    cells = [F.struct(F.lit(code).alias("code"), F.lit(column).alias("column"), F.col(f"{code}:{column}").alias("observed_count")) for code, column in broken]

    payload = F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"})
    ids = events.where(F.trim(F.coalesce("event_id", F.lit(""))) != "").select("event_id", F.sha2(payload, 256).alias("h"))
    ids = ids.groupBy("event_id").agg(F.count("*").alias("n"), (F.min("h") != F.max("h")).alias("differ")).where("n > 1")
    more = lambda when: F.coalesce(F.sum(F.when(when, F.col("n") - 1)), F.lit(0))
    two = ids.agg(more(~F.col("differ")).alias("replay_duplicate"), more(F.col("differ")).alias("conflicting_duplicate"))
    twice = [F.struct(F.lit(c).alias("code"), F.lit("event_id").alias("column"), F.col(c).alias("observed_count")) for c in ("replay_duplicate", "conflicting_duplicate")]
    flat = lambda df, structs: df.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
    return flat(one, cells).unionByName(flat(two, twice)).where("observed_count > 0")
