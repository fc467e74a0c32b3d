"""From landed records to trusted events: typing, validity, replays and conflicts in one aggregation by event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.contracts import EVENT_COLUMNS
from quarrylake.functions.reading import day_of, epoch_of, number_of

#: Reasons of quarantine.
INVALID = "Missing or invalid required business key"
CONFLICT = "Conflicting payloads share the same event ID"
REQUIRED = ("event_id", "machine_id", "event_ts_utc", "site_id", "client_id")
_LOWER, _UPPER = ("event_type", "severity"), ("status", "part_code", "fault_code")
_DOUBLES, _INTS = ("hour_meter", "temperature_c", "vibration_mm_s", "fuel_level_pct", "maintenance_cost_gbp"), ("duration_minutes", "downtime_minutes", "part_quantity")


def require_columns(df: DataFrame, names: set[str], label: str) -> None:
    if lacking := sorted(names - set(df.columns)):
        raise ValueError(f"{label} lacks the columns {', '.join(lacking)}")


def whole_of(c: Column) -> Column:
    """The whole part of a number that reads; NULL beyond the range of an int."""
    return number_of(c).try_cast("int")


def payload() -> Column:
    """The landed columns of a record as JSON, missing ones included."""
    return F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"})


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


#: Stands for NULL where payloads are hashed: no landed text has these characters.
_NOTHING = "\x00\uffff"


def payload_hashes() -> list[Column]:
    """128 bits over the landed columns as they are, NULL apart from any text: what tells differing payloads without their text.

    Hashed as one array: an argument per column makes a generated method that is too long to be compiled further.
    """
    texts = F.array(*[F.coalesce(c, F.lit(_NOTHING)) for c in EVENT_COLUMNS])
    return [F.xxhash64(texts).alias("_h1"), F.xxhash64(F.lit(1), texts).alias("_h2")]


def typed(bronze: DataFrame) -> DataFrame:
    """Landed records with typed columns, event_ts_utc, event_date, event_payload_sha256, is_valid, and hashes of the payload. Text that doesn't read becomes NULL."""
    require_columns(bronze, {*EVENT_COLUMNS, "_ingested_at", "_source_file"}, "bronze")
    # in two steps, for one would make a generated method that is too long to be compiled further
    texts = {**{c: F.lower(F.trim(c)) for c in _LOWER}, **{c: F.upper(F.trim(c)) for c in _UPPER}}
    read = bronze.select(
        *[texts.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS],
        "_ingested_at",
        "_source_file",
        F.sha2(payload(), 256).alias("event_payload_sha256"),
        epoch_of(F.col("event_ts")).alias("_second"),
        *payload_hashes(),
    )
    numbers = {**{c: number_of(F.col(c)) for c in _DOUBLES}, **{c: whole_of(F.col(c)) for c in _INTS}}
    rows = read.select(
        *[numbers.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS],
        "_ingested_at",
        "_source_file",
        "event_payload_sha256",
        F.timestamp_seconds("_second").alias("event_ts_utc"),
        day_of(F.col("_second")).alias("event_date"),
        "_h1",
        "_h2",
    )
    valid = F.lit(True)
    for c in REQUIRED:
        valid = valid & ~blank(F.col(c))
    return rows.withColumn("is_valid", valid)


_DIFFER = "min(_h1) <> max(_h1) or min(_h2) <> max(_h2)"


def enrich(events: DataFrame) -> DataFrame:
    """is_failure_event, health_score and defaults. A missing reading costs no health."""
    lost = lambda when, points: F.when(when, points).otherwise(0)
    health = (
        100
        - lost(F.col("temperature_c") > 90, 20)
        - lost(F.col("vibration_mm_s") > 6, 25)
        - lost(F.col("fuel_level_pct") < 20, 10)
        - lost(F.col("status") == "FAULT", 30)
    )
    return events.withColumns(
        {
            "is_failure_event": (F.col("status") == "FAULT") | (F.col("fault_code").isNotNull() & (F.col("fault_code") != "OK")),
            "health_score": F.greatest(F.lit(0), health),
            "maintenance_cost_gbp": F.coalesce("maintenance_cost_gbp", F.lit(0.0)),
            "part_quantity": F.coalesce("part_quantity", F.lit(0)),
        }
    )


def _by_event(rows: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Per event_id: whether payloads differ among all its records, valid or not, and its newest valid record, or the asked columns of it. Combined before the shuffle."""
    record = F.struct(*[c for c in columns or rows.columns if c not in ("is_valid", "_h1", "_h2")])
    newest = F.when(F.col("is_valid"), F.struct("_ingested_at", "_source_file"))
    packed = rows.where(~blank(F.col("event_id"))).select("event_id", "_h1", "_h2", record.alias("_record"), newest.alias("_at"))
    return packed.groupBy("event_id").agg(F.expr(_DIFFER).alias("is_conflicting_event_id"), F.max_by("_record", "_at").alias("_newest"))


def silver(bronze: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One enriched row per event_id that has a valid record and no differing payloads: the newest, by _ingested_at, then _source_file.

    With columns only these typed ones (those that enrich needs among them) are carried along.
    """
    kept = _by_event(typed(bronze), columns).where("not is_conflicting_event_id and _newest is not null")
    return enrich(kept.select("_newest.*"))


def quarantine(bronze: DataFrame) -> DataFrame:
    """Typed records that aren't trusted, with quarantine_reason and is_conflicting_event_id. A record that is both invalid and in conflict is invalid."""
    rows = typed(bronze)
    flags = _by_event(rows).where("is_conflicting_event_id").select("event_id", "is_conflicting_event_id")
    rows = rows.join(flags, "event_id", "left").withColumn("is_conflicting_event_id", F.coalesce("is_conflicting_event_id", F.lit(False)))
    reason = F.when(~F.col("is_valid"), F.lit(INVALID)).when(F.col("is_conflicting_event_id"), F.lit(CONFLICT))
    return rows.withColumn("quarantine_reason", reason).where("quarantine_reason is not null").drop("is_valid", "_h1", "_h2")


def reconciliation(bronze: DataFrame) -> DataFrame:
    """One row of counts: every landed record is trusted, quarantined or a surplus copy. One pass over two aggregations."""
    per_event = (
        typed(bronze)
        .groupBy("event_id")
        .agg(F.count("*").alias("n"), F.count_if("is_valid").alias("valid"), F.expr(_DIFFER).alias("differ"))
        .withColumn("differ", F.col("differ") & ~blank(F.col("event_id")))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    in_conflict = F.when(F.col("differ"), F.col("valid")).otherwise(0)
    kept = F.when(~F.col("differ") & (F.col("valid") > 0), 1).otherwise(0)
    return per_event.agg(
        total("n").alias("bronze_rows"),
        total("valid").alias("valid_rows_before_deduplication"),
        total(F.col("n") - F.col("valid")).alias("invalid_quarantine_rows"),
        total(in_conflict).alias("conflicting_quarantine_rows"),
        total(F.col("n") - F.col("valid") + in_conflict).alias("quarantine_rows"),
        total(kept).alias("silver_rows"),
        total(F.col("valid") - in_conflict - kept).alias("deduplicated_rows"),
        F.count_if("differ").alias("conflicting_event_ids"),
    )
