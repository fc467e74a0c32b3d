"""The declared shape of landed machine events, from which schemas, typed columns and checks derive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"  # text, instant, number, minutes, count


EVENT_FIELDS = (
    Field("event_id"),
    Field("machine_id"),
    Field("event_ts", "instant"),
    Field("site_id"),
    Field("client_id"),
    Field("model"),
    Field("hour_meter", "number"),
    Field("event_type"),
    Field("status"),
    Field("fault_code"),
    Field("severity"),
    Field("temperature_c", "number"),
    Field("vibration_mm_s", "number"),
    Field("fuel_level_pct", "number"),
    Field("duration_minutes", "minutes"),
    Field("downtime_minutes", "minutes"),
    Field("maintenance_cost_gbp", "number"),
    Field("part_code"),
    Field("part_quantity", "count"),
    Field("operator_shift"),
)
EVENT_COLUMNS = tuple(f.name for f in EVENT_FIELDS)
READINGS = ("temperature_c", "vibration_mm_s", "fuel_level_pct", "hour_meter")


def raw_event_schema() -> T.StructType:
    """Every landed column as nullable text, in landing order; never inferred."""
    return T.StructType([T.StructField(n, T.StringType()) for n in EVENT_COLUMNS])
