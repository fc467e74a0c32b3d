"""Reading landed text: numbers, instants and missing values, as Catalyst expressions.

All of it stays in the JVM. Only U+0020 counts as a blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
_SHAPE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
_ZONE = r"(?:Z|[+-][0-9]{2}:[0-9]{2})"


def existing_date() -> str:
    """A regular expression for the dates of the calendar, leap years included."""
    long_months = r"(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])"
    short_months = r"(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)"
    february = r"02-(?:0[1-9]|1[0-9]|2[0-8])"
    by_four = r"(?:0[48]|[2468][048]|[13579][26])"
    leap = rf"(?:[0-9]{{2}}{by_four}|(?:{by_four}|00)00)-02-29"
    return rf"(?:[0-9]{{4}}-(?:{long_months}|{short_months}|{february})|{leap})"


#: An instant with an existing date and a time from 00:00:00 to 23:59:59.
INSTANT = rf"{existing_date()}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]{_ZONE}"


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def text_of(c: Column) -> Column:
    """The value without surrounding blanks; NULL where it is missing (NULL, empty, all blank)."""
    t = F.trim(c)
    return F.when(t != "", t)


def number_of(c: Column) -> Column:
    """The double that the text denotes; NULL where it is missing or doesn't read. -0 reads as 0."""
    t = F.trim(c)
    return F.when(t.rlike(whole(NUMBER)), t.try_cast("double") + F.lit(0.0))


def epoch_of(c: Column) -> Column:
    """Seconds since 1970-01-01T00:00:00Z of the instant that the text denotes; NULL where it doesn't read."""
    t = F.trim(c)
    local = F.unix_seconds(F.concat(F.substring(t, 1, 19), F.lit("Z")).try_cast("timestamp"))
    offset = F.substring(t, 21, 2).try_cast("int") * 3600 + F.substring(t, 24, 2).try_cast("int") * 60
    sign = F.substring(t, 20, 1)
    shift = F.when(sign == "Z", F.lit(0)).when(sign == "+", -offset).otherwise(offset)
    return F.when(t.rlike(whole(_SHAPE + _ZONE)), local + shift)


def day_of(epoch: Column) -> Column:
    """The UTC date of an epoch second, whatever the session's time zone is."""
    return F.date_from_unix_date(F.floor(epoch / F.lit(86400)).cast("int"))


def minutes_of(c: Column) -> Column:
    """Minutes for totals, as a double: 0 where they are missing or don't read. -0 reads as 0."""
    return F.coalesce(number_of(c), F.lit(0.0))
