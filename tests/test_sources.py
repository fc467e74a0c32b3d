"""What is let in: landing folders, upload plans, fixtures, and reports kept as files."""

import json
import os

import pytest

from quarrylake.contracts import EVENT_COLUMNS
from quarrylake.plans import registry
from quarrylake.sources import fixtures, landing

HEADER = ",".join(EVENT_COLUMNS) + "\n"
GOOD = "E1,M1,2026-01-05T10:00:00Z,S,C,X,12.5,telemetry,RUNNING,OK,none,61.0,2.2,50,60,0,0,NONE,0,DAY\n"


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_preflight_and_guard(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    with pytest.raises(ValueError, match="no landing files"):
        landing.preflight(spark, str(tmp_path))
    landing.land(write(tmp_path.parent / "x.csv", HEADER + GOOD), str(tmp_path / "a" / "b"))
    assert landing.preflight(spark, str(tmp_path)) == 1
    for bounds in ({"max_entries": 2}, {"max_depth": 1}):
        with pytest.raises(ValueError):
            landing.preflight(spark, str(tmp_path), **bounds)
    write(tmp_path / "other.csv", "x")
    with pytest.raises(ValueError, match="1 files"):
        landing.preflight(spark, str(tmp_path))
    good = landing.with_identity(spark.createDataFrame([("machine-events__incremental__sha256_" + "0" * 64 + ".csv",)], "_source_file string"))
    landing.require_identities(good)
    landing.require_identities(spark.createDataFrame([], "x int"))
    for bad in (landing.with_identity(spark.createDataFrame([("x.csv",), (None,)], "_source_file string")), spark.range(1)):
        with pytest.raises(ValueError):
            landing.require_identities(bad)


def test_plans_are_kept_and_checked(tmp_path):
    source = write(tmp_path / "x.csv", HEADER + GOOD)
    planned = landing.plan([source], "rp-1")
    path = str(tmp_path / "plan.json")
    landing.write_plan(planned, path)
    assert landing.load_plan(path) == planned and os.listdir(tmp_path).count("plan.json") == 1
    assert planned["plan_id"] != landing.plan([source])["plan_id"]
    entry = planned["files"][0]
    for bad in ({}, planned | {"more": 1}, planned | {"plan_id": "0"}, planned | {"replay_id": "rp-2"}, planned | {"files": [entry | {"bytes": entry["bytes"] - 1}]}, planned | {"files": [{"source": source}]}):
        with pytest.raises(ValueError):
            landing.check_plan(bad)
    write(tmp_path / "x.csv", HEADER)
    with pytest.raises(ValueError, match="changed"):
        landing.load_plan(path)
    with pytest.raises(ValueError):
        landing.load_plan(str(tmp_path / "nothing.json"))
    with pytest.raises(ValueError):
        landing.write_plan(planned, path, max_bytes=10)


def test_fixtures(spark, tmp_path):
    check = lambda *ps, **b: [(f.file, f.line, f.code, f.column) for f in fixtures.validate(spark, ps, fixtures.Bounds(**b))]
    good = write(tmp_path / "good.csv", HEADER + GOOD)
    assert check(good) == [] and check() == [("", 0, "no_fixtures", "")] and check(good, good, files=1) == [("", 0, "file_count_limit_exceeded", "")]
    os.symlink(good, tmp_path / "link.csv")
    cases = {
        "link.csv": (None, (0, "symlink_not_allowed")), "dir.csv": (None, (0, "non_regular_file")), "gone.csv": (None, (0, "file_read_error")), "empty.csv": ("", (0, "empty_fixture")), "head.csv": ("a,b\n", (1, "header_mismatch")),
        "none.csv": (HEADER, (0, "no_data_rows")), "quote.csv": (HEADER + '"E1"x,\n', (0, "csv_parse_error")), "bytes.csv": (b"\xff\xfe\x00", (0, "csv_parse_error")), "short.csv": (HEADER + "E1,M1\n", (2, "row_shape_invalid")),
    }
    (tmp_path / "dir.csv").mkdir()
    for name, (text, (line, code)) in cases.items():
        path = str(tmp_path / name) if text is None else write(tmp_path / name, text)
        assert check(path) == [(name, line, code, "")]
    assert check(good, file_bytes=100) == [("good.csv", 0, "file_size_limit_exceeded", "")]
    again = write(tmp_path / "more.csv", HEADER + GOOD + GOOD.replace("61.0", "hot") + GOOD.replace("E1,M1", "E2,").replace(",60,0,0,", ",060,99999999999,-1,"))
    found = check(good, again)
    assert found == [
        ("more.csv", 2, "replay_duplicate", "event_id"), ("more.csv", 3, "conflicting_duplicate", "event_id"), ("more.csv", 3, "decimal_invalid", "temperature_c"),
        ("more.csv", 4, "integer_format_invalid", "duration_minutes"), ("more.csv", 4, "integer_range_violation", "downtime_minutes"), ("more.csv", 4, "non_negative_violation", "maintenance_cost_gbp"),
        ("more.csv", 4, "required_key_missing", "machine_id"),
    ]
    assert check(good, again, findings=3)[-1] == ("", 0, "finding_limit_exceeded", "") and len(check(good, again, findings=3)) == 3
    assert ("more.csv", 2, "row_limit_exceeded", "") in check(good, again, rows=1)
    assert check(good, again, total_bytes=400)[-1][2] == "total_size_limit_exceeded"
    assert [f.severity for f in fixtures.validate(spark, [good, again])][0] == "info"


def test_registry(spark, tmp_path):
    entry = {"display_name": "One", "description": "d", "file": "one.sql"}
    write(tmp_path / "one.sql", "select id + 1 as n from range(3);\n")
    put = lambda listed: write(tmp_path / "manifest.json", json.dumps(listed))
    put([entry])
    (asset,) = registry.load(str(tmp_path))
    assert asset.display_name == "One" and [r.n for r in asset.run(spark).collect()] == [1, 2, 3]
    os.symlink(tmp_path / "one.sql", tmp_path / "link.sql")
    write(tmp_path / "blank.sql", " \n")
    bad = [[], {}, [entry, entry], [entry | {"x": "y"}], [entry | {"description": " "}], *[[entry | {"file": f}] for f in ("../one.sql", "one.txt", " one.sql", "gone.sql", "link.sql", "blank.sql")]]
    for listed in bad:
        put(listed)
        with pytest.raises(ValueError):
            registry.load(str(tmp_path))
    put([entry])
    for bounds in ({"max_assets": 0}, {"max_bytes": 5}):
        with pytest.raises(ValueError):
            registry.load(str(tmp_path), **bounds)
