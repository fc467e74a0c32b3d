"""Checking a few small landing files before they are let in: their shape here, their records by the landing contract.

Everything is bounded: so many files, bytes, rows and findings. What is checked at scale are landed records, see
operators.conformance.
"""

from __future__ import annotations

import csv
import io
import os
import stat
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from quarrylake.contracts import EVENT_COLUMNS
from quarrylake.operators import conformance


@dataclass(frozen=True)
class Bounds:
    files: int = 100
    file_bytes: int = 2_000_000
    total_bytes: int = 10_000_000
    rows: int = 100_000
    findings: int = 1_000


@dataclass(frozen=True, order=True)
class Finding:
    """line is that of the record, counted from 1 with the header; 0 where the finding is about the file."""

    file: str
    line: int
    code: str
    column: str = ""
    severity: str = "error"


def _content(path: str, bounds: Bounds, found: list[Finding]) -> bytes | None:
    """The content of a regular file within bounds, read as one state; None with a finding."""
    name = os.path.basename(path)
    try:
        before = os.lstat(path)
        if stat.S_ISLNK(before.st_mode) or not stat.S_ISREG(before.st_mode):
            found.append(Finding(name, 0, "symlink_not_allowed" if stat.S_ISLNK(before.st_mode) else "non_regular_file"))
            return None
        with open(path, "rb") as f:
            content = f.read(bounds.file_bytes + 1)
        after = os.lstat(path)
    except OSError:
        found.append(Finding(name, 0, "file_read_error"))
        return None
    if (before.st_ino, before.st_dev, before.st_size, before.st_mtime_ns) != (after.st_ino, after.st_dev, after.st_size, after.st_mtime_ns):
        found.append(Finding(name, 0, "file_identity_changed"))
        return None
    if not 0 < len(content) <= bounds.file_bytes:
        found.append(Finding(name, 0, "file_size_limit_exceeded" if content else "empty_fixture"))
        return None
    return content


def validate(spark: SparkSession, paths: Sequence[str], bounds: Bounds = Bounds()) -> list[Finding]:
    """What is wrong with the files, in order of file and line. Replays are told as information; all else are errors.

    Beyond the bound of findings the list ends with finding_limit_exceeded.
    """
    found: list[Finding] = []
    if not paths:
        return [Finding("", 0, "no_fixtures")]
    if len(paths) > bounds.files:
        return [Finding("", 0, "file_count_limit_exceeded")]
    rows, total = [], 0
    for path in sorted(paths):
        name, content = os.path.basename(path), _content(path, bounds, found)
        if content is None:
            continue
        if (total := total + len(content)) > bounds.total_bytes:
            found.append(Finding(name, 0, "total_size_limit_exceeded"))
            break
        try:
            reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), strict=True)
            header = next(reader, [])
            if tuple(header) != EVENT_COLUMNS:
                found.append(Finding(name, 1, "header_mismatch"))
                continue
            some = False
            for values in reader:
                some = True
                if len(values) != len(EVENT_COLUMNS):
                    found.append(Finding(name, reader.line_num, "row_shape_invalid"))
                elif len(rows) >= bounds.rows:
                    found.append(Finding(name, reader.line_num, "row_limit_exceeded"))
                    break
                else:
                    rows.append((name, reader.line_num, *values))
            if not some:
                found.append(Finding(name, 0, "no_data_rows"))
        except (csv.Error, UnicodeDecodeError):
            found.append(Finding(name, 0, "csv_parse_error"))
    if rows:
        df = spark.createDataFrame(rows, "_file string, _line int, " + ", ".join(f"{c} string" for c in EVENT_COLUMNS))
        broken = conformance.violations(df, "_file", "_line").limit(bounds.findings + 1).collect()
        found += [Finding(r["_file"], r["_line"], r["code"], r["column"]) for r in broken]
        first: dict[str, tuple] = {}
        for name, line, *values in rows:  # at most bounds.rows
            if (key := values[0]).strip():
                if key not in first:
                    first[key] = tuple(values)
                elif first[key] == tuple(values):
                    found.append(Finding(name, line, "replay_duplicate", "event_id", "info"))
                else:
                    found.append(Finding(name, line, "conflicting_duplicate", "event_id"))
    found.sort()
    return found if len(found) <= bounds.findings else [*found[: bounds.findings - 1], Finding("", 0, "finding_limit_exceeded")]
