from datetime import date

import pytest
from pyspark.sql import functions as F

from quarrylake.functions.reading import day_of, epoch_of, minutes_of, number_of, text_of

NUMBERS = {
    "1": 1.0, " +1.5e+3 ": 1500.0, "-.5": -0.5, "5.": 5.0, "1E2": 100.0, "-0": 0.0, "": None, "  ": None, "null": None, "NaN": None, "Infinity": None,
    "-inf": None, "1f": None, "1D": None, "0x1F": None, "1,5": None, "1..5": None, "1e": None, ".": None, "+": None, "- 5": None, "1 000": None, "\t1": None, "١": None,
}
INSTANTS = {
    "2026-01-02T03:04:05Z": 1767323045, " 2026-01-02T03:04:05+01:00 ": 1767319445, "2026-01-02T03:04:05-05:30": 1767342845, "2024-02-29T00:00:00Z": 1709164800,
    "2026-02-29T00:00:00Z": None, "2026-13-01T00:00:00Z": None, "2026-01-01T24:00:00Z": None, "2026-01-01T23:59:60Z": None, "2026-01-01T00:61:00Z": None,
    "2026-01-01T00:00:00": None, "2026-01-01": None, "20260101T000000Z": None, "1767323045": None, "2026-01-01T00:00:00+1:00": None, "2026-01-01T00.00.00Z": None,
    "2026-01-01T00:00:00z": None, "2026-01-01 00:00:00Z": None, "": None, "pending": None, "2026-01-01T00:00:00.5Z": None,
}


def _read(spark, values, f):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    return {r.v: r.x for r in df.select("v", f(F.col("v")).alias("x")).collect()}


def test_numbers(spark):
    assert _read(spark, NUMBERS, number_of) == {**NUMBERS, None: None}


def test_instants(spark):
    assert _read(spark, INSTANTS, epoch_of) == {**INSTANTS, None: None}


def test_text_and_minutes(spark):
    assert _read(spark, [" a b ", " ", ""], text_of) == {" a b ": "a b", " ": None, "": None, None: None}
    got = _read(spark, ["90", "1e9", "-5", "x"], minutes_of)
    assert {k: float(v) for k, v in got.items()} == {"90": 90.0, "1e9": 1e9, "-5": -5.0, "x": 0.0, None: 0.0}


@pytest.mark.parametrize("second, day", [(0, date(1970, 1, 1)), (86_399, date(1970, 1, 1)), (-1, date(1969, 12, 31))])
def test_day_is_utc(spark, second, day):
    assert spark.range(1).select(day_of(F.lit(second)).alias("d")).first().d == day
