"""Separating records that don't parse, with the reason, while loading the sound ones.

One anchored expression per schema decides a whole record. Only what fails it runs through patterns of growing field
prefixes, which name the first broken thing. All expressions are possessive: no input makes them backtrack.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.contracts import EVENT_FIELDS, Field
from quarrylake.functions.reading import INSTANT, NUMBER, epoch_of, number_of, text_of, whole

QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
PLAIN = r'[^",]*+'
#: A quoted field must be followed by a comma or the end, a plain one can't hold a quote.
FIELD = rf'(?:{QUOTED}(?=,|\z)|(?!"){PLAIN}(?=,|\z))'
#: What a field must hold, by its declared role; the text may carry blanks and quotes around it.
REQUIRED_INSTANT, OPTIONAL_NUMBER = INSTANT, rf"(?:{NUMBER})?+"
CHECKED = {"event_ts": REQUIRED_INSTANT, "hour_meter": OPTIONAL_NUMBER, "temperature_c": OPTIONAL_NUMBER}
#: All that the contract declares: every instant and every number.
ALL_CHECKED = {f.name: REQUIRED_INSTANT if f.kind == "instant" else OPTIONAL_NUMBER for f in EVENT_FIELDS if f.kind != "text"}


def _typed(pattern: str) -> str:
    """A field whose text, within quotes or not, is the pattern between blanks."""
    return rf'(?:" *+(?:{pattern}) *+"(?=,|\z)| *+(?:{pattern}) *+(?=,|\z))'


def row_pattern(fields: Iterable[Field] = EVENT_FIELDS, checked: dict[str, str] = CHECKED) -> str:
    """The anchored expression of a sound record: every field delimited, the checked ones typed, none too many."""
    return r"\A" + ",".join(_typed(checked[f.name]) if f.name in checked else FIELD for f in fields) + r"\z"


def prefix_patterns(fields: Iterable[Field] = EVENT_FIELDS, checked: dict[str, str] = CHECKED) -> list[tuple[str, str]]:
    """(reason, pattern) in order of reasons: the first pattern that a record doesn't match names what is broken."""
    fields = list(fields)
    steps = [("quoting", rf"\A{FIELD}(?:,{FIELD})*+\z"), ("column_count", r"\A" + ",".join([FIELD] * len(fields)) + r"\z")]
    for name, pattern in checked.items():
        k = next(i for i, f in enumerate(fields) if f.name == name)
        steps.append((name, r"\A" + rf"(?:{FIELD},){{{k}}}+" + _typed(pattern)))
    return steps


def reason_of(line: Column, fields: Iterable[Field] = EVENT_FIELDS, checked: dict[str, str] = CHECKED) -> Column:
    """NULL for a sound record, else the first reason that applies. A NULL record has no field: column_count."""
    fields = list(fields)
    broken = F.lit(None).cast("string")
    for name, pattern in reversed(prefix_patterns(fields, checked)):
        broken = F.when(~line.rlike(pattern), F.lit(name)).otherwise(broken)
    return F.when(line.isNull(), F.lit("column_count")).when(line.rlike(row_pattern(fields, checked)), F.lit(None)).otherwise(broken)


def column_reason(checked: dict[str, str] = CHECKED) -> Column:
    """The same for records that are landed as columns: the first checked column that doesn't read."""
    reason = F.lit(None).cast("string")
    for name, pattern in reversed(list(checked.items())):
        reason = F.when(~F.trim(F.coalesce(F.col(name), F.lit(""))).rlike(whole(pattern)), F.lit(name)).otherwise(reason)
    return reason


def split_fields(line: Column) -> Column:
    """The fields of a record whose quoting is sound, unquoted, as an array."""
    parts = F.regexp_extract_all(line, F.lit(rf"(?:\A|,)({FIELD})"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.startswith('"'), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p))


def typed_events(rows: DataFrame, get) -> DataFrame:
    """record_id, the event's columns in their declared kinds, and unread_columns; get gives a landed column of rows by name.

    unread_columns names, in order, the columns whose text is there, but doesn't read and so became NULL; NULL where there are none.
    """
    read = {"instant": lambda c: F.timestamp_seconds(epoch_of(c)), "text": text_of}
    others = [f.name for f in EVENT_FIELDS if f.kind != "text"]
    typed = rows.select(
        "record_id",
        *[read.get(f.kind, number_of)(get(f.name)).alias(f.name) for f in EVENT_FIELDS],
        F.transform(F.array(*[get(n) for n in others]), lambda c: F.coalesce(F.trim(c) != "", F.lit(False))).alias("_there"),
    )
    names = F.concat_ws(",", *[F.when(F.get("_there", F.lit(i)) & F.col(n).isNull(), F.lit(n)) for i, n in enumerate(others)])
    return typed.select("record_id", *[f.name for f in EVENT_FIELDS], F.when(names != "", names).alias("unread_columns"))


def load_lines(lines: DataFrame, checked: dict[str, str] = CHECKED) -> tuple[DataFrame, DataFrame]:
    """(sound, broken): typed events with record_id, and record_id with reason, of a table with record_id and raw_line.

    checked are the fields that must read, in the order in which they are blamed; ALL_CHECKED are all. A value of another
    field that doesn't read is NULL in the event and named in unread_columns. An empty line is a record of one field.
    Further columns are ignored, repeated rows stay repeated.
    """
    judged = lines.select("record_id", "raw_line", reason_of(F.col("raw_line"), EVENT_FIELDS, checked).alias("reason"))
    at = {f.name: i for i, f in enumerate(EVENT_FIELDS)}
    fields = judged.where("reason is null").select("record_id", split_fields(F.col("raw_line")).alias("_f"))
    sound = typed_events(fields, lambda n: F.get(F.col("_f"), at[n]))
    return sound, judged.where("reason is not null").select("record_id", "reason")


def load_columns(events: DataFrame, checked: dict[str, str] = CHECKED) -> tuple[DataFrame, DataFrame]:
    """(sound, broken) of records that are landed as 20 text columns and record_id."""
    reason = column_reason(checked)
    sound = typed_events(events.where(reason.isNull()), F.col)
    return sound, events.select("record_id", reason.alias("reason")).where("reason is not null")


def unreadable(lines: DataFrame, events: DataFrame, checked: dict[str, str] = CHECKED) -> DataFrame:
    """record_id and reason of every unreadable record of both tables."""
    return load_lines(lines, checked)[1].unionByName(load_columns(events, checked)[1])


def loaded(lines: DataFrame, events: DataFrame, checked: dict[str, str] = CHECKED) -> DataFrame:
    """The sound records of both tables as typed events."""
    return load_lines(lines, checked)[0].unionByName(load_columns(events, checked)[0])
