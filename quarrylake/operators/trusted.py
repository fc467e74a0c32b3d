"""One row per event that was landed without contradiction.

Copies of an event agree when their 19 other columns are equal in value: instants as instants, numbers as numbers,
text without surrounding blanks and letter case, missing equal to missing only. Text that doesn't read as the declared
kind is compared as text. One aggregation with map-side combine finds the copies, so that an id delivered very often
reaches its reducer as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.contracts import EVENT_FIELDS
from quarrylake.functions.reading import epoch_of, minutes_of, number_of, text_of


def _value(name: str, kind: str) -> Column:
    """What is hashed of a column: the value it denotes, or where it doesn't read a hash of its text. Never NULL: a hash would skip it."""
    text = F.coalesce(F.lower(F.trim(F.col(name))), F.lit(""))
    if kind == "text":
        return text
    if kind == "instant":
        return F.coalesce(epoch_of(F.col(name)), F.xxhash64(text))
    return F.coalesce(number_of(F.col(name)), F.xxhash64(text).cast("double"))


def payload_hash() -> Column:
    """64 bits over what copies must agree on."""
    return F.xxhash64(*[_value(f.name, f.kind) for f in EVENT_FIELDS if f.name != "event_id"])


def contradicting_ids(events: DataFrame) -> DataFrame:
    """event_id of every event whose copies don't all agree."""
    rows = events.select(text_of(F.col("event_id")).alias("event_id"), payload_hash().alias("_h")).where("event_id is not null")
    return rows.groupBy("event_id").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi")).where("_lo <> _hi").select("event_id")


_TYPED = {
    "site_id": lambda: text_of(F.col("site_id")),
    "duration_minutes": lambda: minutes_of(F.col("duration_minutes")),
    "downtime_minutes": lambda: minutes_of(F.col("downtime_minutes")),
    **{n: (lambda n=n: number_of(F.col(n))) for n in ("temperature_c", "vibration_mm_s", "fuel_level_pct", "hour_meter")},
}


def trusted_events(events: DataFrame, *columns: str) -> DataFrame:
    """event_id, machine_id, epoch_s and the asked columns of every event_id that isn't contradicting and whose event_ts reads.

    Rows without an event_id carry no event and are left out, and so are events without a machine_id, once all their
    copies are compared. Where copies agree, but differ in letter case, the greater text stands. An empty table gives an empty table; further columns of the input are ignored.
    """
    typed = events.select(
        text_of(F.col("event_id")).alias("event_id"),
        text_of(F.col("machine_id")).alias("machine_id"),
        epoch_of(F.col("event_ts")).alias("epoch_s"),
        *[_TYPED[c]().alias(c) for c in columns],
        payload_hash().alias("_h"),
    ).where("event_id is not null")
    one = typed.groupBy("event_id").agg(
        F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), *[F.max(c).alias(c) for c in ("machine_id", "epoch_s", *columns)]
    )
    return one.where("_lo = _hi and machine_id is not null and epoch_s is not null").drop("_lo", "_hi")


def landed_times(events: DataFrame) -> DataFrame:
    """machine_id and epoch_s of every landed record, copies and contradictions included: what there is at least, read from two columns. NULL where missing."""
    return events.select(text_of(F.col("machine_id")).alias("machine_id"), epoch_of(F.col("event_ts")).alias("epoch_s"))
