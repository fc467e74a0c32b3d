"""Landing files that carry their identity in their name, and what of it every record keeps."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.contracts import raw_event_schema

#: Fixed format of a landing file's name.
NAME = r"^machine-events__(incremental|backfill)(?:__replay_([A-Za-z0-9._-]{1,64}))?__sha256_([0-9a-f]{64})[.]csv$"


@dataclass(frozen=True)
class Identity:
    mode: str
    replay_id: str | None
    sha256: str


def object_name(content: bytes, replay_id: str | None = None) -> str:
    """The name under which content lands: the same content has the same name."""
    name = f"machine-events__{'backfill__replay_' + replay_id if replay_id else 'incremental'}__sha256_{hashlib.sha256(content).hexdigest()}.csv"
    if not re.match(NAME, name):
        raise ValueError("replay_id must have 1 to 64 letters, digits, dots, dashes or underscores")
    return name


def parse_name(name: str) -> Identity | None:
    """None where the name isn't a landing file's: a backfill has a replay, an incremental file none."""
    m = re.match(NAME, name)
    return Identity(*m.groups()) if m and (m[1] == "backfill") == bool(m[2]) else None


def land(source: str, folder: str, replay_id: str | None = None) -> str:
    """Copies a CSV file into the landing folder under its name. What is there is never overwritten: equal content stays, other content raises."""
    with open(source, "rb") as f:
        content = f.read()
    target = os.path.join(folder, object_name(content, replay_id))
    try:
        with open(target, "xb") as f:
            f.write(content)
    except FileExistsError:
        with open(target, "rb") as f:
            if f.read() != content:
                raise ValueError(f"{target} has other content") from None
    return target


def plan(sources: list[str], replay_id: str | None = None, max_files: int = 20, max_bytes: int = 10 << 20, max_total: int = 50 << 20) -> dict:
    """What would land: each source with its target name and size, and an id that equal plans share. Raises beyond the bounds, on links, and where two sources are one content."""
    entries = []
    for path in sources:
        if os.path.islink(path) or not os.path.isfile(path):
            raise ValueError(f"{path} is no regular file")
        with open(path, "rb") as f:
            content = f.read(max_bytes + 1)
        if len(content) > max_bytes:
            raise ValueError(f"{path} is larger than {max_bytes} bytes")
        entries.append({"source": path, "name": object_name(content, replay_id), "bytes": len(content)})
    entries.sort(key=lambda e: e["name"])
    if len(entries) > max_files or sum(e["bytes"] for e in entries) > max_total or len({e["name"] for e in entries}) < len(entries):
        raise ValueError("too many files, too many bytes, or one content twice")
    return {"plan_id": plan_id(entries, replay_id), "replay_id": replay_id, "files": entries}


def plan_id(entries: list[dict], replay_id: str | None) -> str:
    """An id that equal plans share: it signs names, sizes and the replay, not where the sources lie."""
    signed = {"replay_id": replay_id, "files": [[e["name"], e["bytes"]] for e in entries]}
    return hashlib.sha256(json.dumps(signed, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_plan(planned: dict) -> dict:
    """planned, if it has the shape of a plan and its id and names are what its entries give. Raises otherwise, and where a source's content is no longer the planned one."""
    if not isinstance(planned, dict) or set(planned) != {"plan_id", "replay_id", "files"} or not isinstance(planned["files"], list):
        raise ValueError("no upload plan")
    for e in planned["files"]:
        if not isinstance(e, dict) or set(e) != {"source", "name", "bytes"} or type(e["bytes"]) is not int or not (named := parse_name(e["name"])):
            raise ValueError("an entry of the plan has another shape")
        if named.replay_id != planned["replay_id"]:
            raise ValueError(f"{e['name']} belongs to another replay")
        with open(e["source"], "rb") as f:
            if object_name(f.read(e["bytes"] + 1), planned["replay_id"]) != e["name"]:
                raise ValueError(f"{e['source']} has changed since it was planned")
    if planned["plan_id"] != plan_id(planned["files"], planned["replay_id"]):
        raise ValueError("the plan's id isn't that of its entries")
    return planned


def write_plan(planned: dict, path: str, max_bytes: int = 1 << 20) -> None:
    """Writes a plan beside its place and puts it there in one step."""
    text = json.dumps(planned, sort_keys=True, indent=2) + "\n"
    if len(text.encode()) > max_bytes:
        raise ValueError("the plan is too large")
    draft = os.path.join(os.path.dirname(os.path.abspath(path)), f".{os.path.basename(path)}.draft")
    with open(draft, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(draft, path)


def load_plan(path: str, max_bytes: int = 1 << 20) -> dict:
    """The checked plan at path; raises where it is a link, no regular file, too large, or doesn't parse."""
    if os.path.islink(path) or not os.path.isfile(path) or not 0 < os.path.getsize(path) <= max_bytes:
        raise ValueError(f"{path} is no plan")
    with open(path, encoding="utf-8") as f:
        return check_plan(json.load(f))


def preflight(spark: SparkSession, folder: str, max_entries: int = 1000, max_depth: int = 8) -> int:
    """The number of landing files under folder, on any file system. Raises beyond the bounds, on names that aren't a landing file's, and where there are none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    pending, seen, files, odd = [(root, 0)], 0, 0, 0
    while pending:
        at, depth = pending.pop()
        if depth > max_depth:
            raise ValueError(f"{folder} is nested deeper than {max_depth}")
        found = fs.listStatusIterator(at)
        while found.hasNext():
            entry = found.next()
            if (seen := seen + 1) > max_entries:
                raise ValueError(f"{folder} has more than {max_entries} entries")
            if entry.isDirectory():
                pending.append((entry.getPath(), depth + 1))
            else:
                files += 1
                odd += parse_name(entry.getPath().getName()) is None
    if odd or not files:
        raise ValueError(f"{odd} files of {folder} are no landing files" if odd else f"{folder} has no landing files")
    return files


IDENTITY = ("_source_object_name", "_ingestion_mode", "_replay_id", "_source_content_sha256", "_source_identity_valid")


def require_identities(bronze: DataFrame) -> None:
    """Raises where records that were ingested before lack the identity of their file, or have one that isn't valid. Stops at the first."""
    lacking = sorted(set(IDENTITY) - set(bronze.columns))
    if lacking and not bronze.isEmpty():
        raise ValueError(f"ingested records lack {', '.join(lacking)}")
    if not lacking and not bronze.where(~F.coalesce("_source_identity_valid", F.lit(False))).isEmpty():
        raise ValueError("ingested records have a file without a valid identity")


def unmanaged(spark: SparkSession, folder: str) -> DataFrame:
    """path of files in the landing folder whose name or content is not what it says; contents are hashed where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(~name.rlike(NAME) | (F.regexp_extract(name, NAME, 3) != F.sha2("content", 256))).select("path")


def with_identity(records: DataFrame) -> DataFrame:
    """Adds _source_object_name, _ingestion_mode, _replay_id, _source_content_sha256 and _source_identity_valid from _source_file. Names that aren't a landing file's give empty text and false."""
    name = F.regexp_extract("_source_file", r"([^/]+)$", 1)
    part = lambda i: F.regexp_extract(name, NAME, i)
    valid = ((part(1) == "incremental") & (part(2) == "")) | ((part(1) == "backfill") & (part(2) != ""))
    return records.withColumns(
        {
            "_source_object_name": name,
            "_ingestion_mode": part(1),
            "_replay_id": F.when(part(1) == "backfill", part(2)),
            "_source_content_sha256": part(3),
            "_source_identity_valid": F.coalesce(valid, F.lit(False)),
        }
    )


def ingestion_coverage(bronze: DataFrame) -> DataFrame:
    """Rows, files, replays and rows without a valid identity by day of arrival and mode."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds("_ingested_at") / 86_400).cast("int"))
    return with_identity(bronze).groupBy(day.alias("ingestion_date"), F.when(F.col("_ingestion_mode") != "", F.col("_ingestion_mode")).otherwise("invalid").alias("ingestion_mode")).agg(
        F.count("*").alias("row_count"),
        F.count_distinct("_source_object_name").alias("source_object_count"),
        F.count_if(~F.col("_source_identity_valid")).alias("invalid_source_identity_row_count"),
        F.count_distinct("_replay_id").alias("replay_id_count"),
    )


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All landing files as raw records with lineage; every column is text."""
    rows = spark.read.schema(raw_event_schema()).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    return rows.select(*[c for c in rows.columns], F.current_timestamp().alias("_ingested_at"), F.col("_metadata.file_path").alias("_source_file"))


