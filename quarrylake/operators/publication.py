"""Publishing a family of datasets as one version: data first, its evidence, and the manifest last.

Each run's datasets are written to a partition of their own; a run shows once its manifest row says COMMITTED. The
manifest is an append-only log, of which each run's last row counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States of a run.
STARTED, COMMITTED, FAILED = "STARTED", "COMMITTED", "FAILED"
MANIFEST = "family string, run_id string, state string, started_at string, completed_at string, evidence string, failure_code string, logged_at timestamp"


def fingerprint(df: DataFrame) -> dict[str, object]:
    """Evidence of a dataset's content: rows, schema and payload digest, whatever the order of rows and columns.

    Names and types count, nullability doesn't (files lose it). One aggregation: extremes of row digests and the sum of
    row hashes, which a changed, lost or repeated row alters.
    """
    names = sorted(df.columns)
    schema = hashlib.sha256(json.dumps([[n, dict(df.dtypes)[n]] for n in names]).encode()).hexdigest()
    row = F.to_json(F.struct(*names), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"})
    rows = df.select(F.sha2(row, 256).alias("d"), F.xxhash64(row).cast("decimal(38,0)").alias("h"))
    one = rows.agg(F.count("*"), F.min("d"), F.max("d"), F.sum("h")).first()
    return {"row_count": one[0], "schema_sha256": schema, "payload_sha256": hashlib.sha256("|".join(map(str, one)).encode()).hexdigest()}


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Family:
    """Versions of a family of datasets under root, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        if not re.fullmatch(r"[a-z][a-z0-9_]{0,63}", name):
            raise ValueError("a family's name has small letters, digits and underscores")
        self.spark, self.root, self.name = spark, root, name

    def _log(self, run_id: str, state: str, started: str, evidence: str, completed: str | None = None, failure: str | None = None) -> None:
        row = [(self.name, run_id, state, started, completed, evidence, failure)]
        df = self.spark.createDataFrame(row, MANIFEST.rpartition(",")[0]).withColumn("logged_at", F.current_timestamp())
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _there(self, path: str) -> bool:
        """Whether a path exists. What can't be read for another reason raises: it isn't taken for something that isn't there."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifest(self) -> DataFrame:
        """The last row of each run."""
        if self._there("manifest"):
            log = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        else:  # nothing published yet
            log = self.spark.createDataFrame([], MANIFEST)
        w = W.partitionBy("family", "run_id").orderBy(F.col("logged_at").desc(), (F.col("state") == STARTED).asc())
        return log.where(F.col("family") == self.name).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def publish(self, run_id: str, frames: Mapping[str, DataFrame]) -> None:
        """Writes the frames under run_id, reads them back against their evidence, and commits. A committed run is never written again."""
        if not re.fullmatch(r"[A-Za-z0-9._:-]{1,128}", run_id):
            raise ValueError("a run id has 1 to 128 letters, digits, dots, dashes, colons or underscores")
        before = self.manifest().where(F.col("run_id") == run_id).first()
        if before and before.state == COMMITTED:
            raise ValueError(f"run {run_id} is committed")
        started, evidence = _now(), json.dumps({n: fingerprint(df) for n, df in frames.items()}, sort_keys=True)
        self._log(run_id, STARTED, started, evidence)
        try:
            for n, df in frames.items():
                df.write.mode("overwrite").parquet(f"{self.root}/{n}/run={run_id}")
            if found := self.audit_frames(evidence, {n: self.read(n, run_id) for n in frames}):
                raise RuntimeError(f"read back with findings: {found}")
        except Exception as e:
            self._log(run_id, FAILED, started, evidence, _now(), type(e).__name__)
            raise
        self._log(run_id, COMMITTED, started, evidence, _now())

    def read(self, dataset: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{dataset}/run={run_id}")

    @staticmethod
    def audit_frames(evidence: str, frames: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
        """(finding, dataset) where frames differ from their evidence."""
        want, found = json.loads(evidence), []
        for n in sorted({*want, *frames}):
            if n not in frames or n not in want:
                found.append(("history_dataset_mismatch", n))
                continue
            have = fingerprint(frames[n])
            for key, code in (("schema_sha256", "history_schema_mismatch"), ("row_count", "history_row_count_mismatch"), ("payload_sha256", "history_payload_mismatch")):
                if have[key] != want[n][key]:
                    found.append((code, n))
                    break
        return found

    def latest(self) -> str | None:
        """The run that shows: of the committed ones the last completed."""
        row = self.manifest().where((F.col("state") == COMMITTED) & F.col("completed_at").isNotNull()).orderBy(F.desc("completed_at"), F.desc("run_id")).first()
        return row.run_id if row else None

    def current(self, dataset: str, empty: T.StructType | None = None) -> DataFrame | None:
        """The dataset of the run that shows. Before the first commit an empty frame of the schema given, else None."""
        run = self.latest()
        return self.read(dataset, run) if run else self.spark.createDataFrame([], empty) if empty else None

    def create_views(self, datasets: Iterable[str]) -> str | None:
        """Points the temporary views {family}_{dataset} at the run that shows; its id, or None before the first commit."""
        if run := self.latest():
            for n in datasets:
                self.read(n, run).createOrReplaceTempView(f"{self.name}_{n}")
        return run

    def audit(self, run_id: str, datasets: Iterable[str] | None = None) -> list[tuple[str, str]]:
        """Findings about a run: not there or there twice, not committed, evidence or data that don't read, or data no longer what was published.

        datasets are those that the family has; a manifest that names others, or lacks some, is a finding for each.
        """
        rows = self.manifest().where(F.col("run_id") == run_id).limit(2).collect()
        if not rows:
            return [("missing_manifest_run", self.name)]
        commits = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").where((F.col("family") == self.name) & (F.col("run_id") == run_id) & (F.col("state") == COMMITTED)).count()
        if commits > 1:
            return [("duplicate_manifest_run", self.name)]
        if rows[0].state != COMMITTED:
            return [("run_not_committed", self.name)]
        try:
            names = set(json.loads(rows[0].evidence))
            for evidence in json.loads(rows[0].evidence).values():
                evidence["row_count"], evidence["schema_sha256"], evidence["payload_sha256"]
        except (TypeError, ValueError, AttributeError, KeyError):
            return [("manifest_evidence_unreadable", self.name)]
        found, frames = [("manifest_dataset_mismatch", n) for n in sorted(names ^ set(names if datasets is None else datasets))], {}
        for n in sorted(names):
            if not self._there(f"{n}/run={run_id}"):
                continue
            try:
                frames[n] = self.read(n, run_id)
            except AnalysisException:  # no file has a schema
                found.append(("history_schema_unreadable", n))
        unread = {n for code, n in found if code == "history_schema_unreadable"}
        return found + [f for f in self.audit_frames(rows[0].evidence, frames) if f[1] not in unread]

    def superseded(self, keep: int) -> DataFrame:
        """run_id of committed runs beyond the newest keep, which may be removed; started and failed ones stay for their owners."""
        w = W.orderBy(F.desc("completed_at"), F.desc("run_id"))  # a row per run
        return self.manifest().where(F.col("state") == COMMITTED).withColumn("_r", F.row_number().over(w)).where(F.col("_r") > keep).select("run_id")


def bootstrap(df: DataFrame, path: str) -> None:
    """Makes an empty dataset of df's schema at path; leaves one that is there as it is."""
    df.limit(0).write.mode("ignore").parquet(path)


def stamped(df: DataFrame, run_id: str, column: str = "publication_run_id") -> DataFrame:
    """df with the run's id: added where there is none, checked where there is. A row of another run, or of none, raises."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(run_id))
    if not df.where(~F.col(column).eqNullSafe(F.lit(run_id))).isEmpty():
        raise ValueError(f"{column} has rows of other runs than {run_id}")
    return df


def pair_manifest(manifest: DataFrame, forecast: str = "forecast", validation: str = "validation") -> DataFrame:
    """The manifest of a family of a forecast and its validation, with the evidence of both in columns."""
    part = lambda d, e: F.get_json_object("evidence", f"$.{d}.{e}")
    evidence = [
        c
        for n, d in (("forecast", forecast), ("validation", validation))
        for c in (part(d, "row_count").cast("bigint").alias(f"{n}_row_count"), *[part(d, f"{e}_sha256").alias(f"{n}_{e}_sha256") for e in ("schema", "payload")])
    ]
    when = lambda c, n: F.to_timestamp(F.col(c)).alias(n)
    return manifest.select(
        F.col("run_id").alias("forecast_run_id"), F.col("state").alias("publication_state"), when("started_at", "publication_started_at_utc"), when("completed_at", "publication_completed_at_utc"), *evidence
    )


#: Days that each log is kept, and its least number of committed entries.
RETENTION = {
    "quality_check_results": (90, 2),
    "quality_metric_history": (180, 2),
    "forecast_history": (180, 2),
    "forecast_publication_manifest": (365, 3),
    "expectation_event_log": (90, 2),
}


def retention_plan(entries: DataFrame, captured_at: datetime, retention: Mapping[str, tuple[int, int]] = RETENTION, recovery_hours: int = 168) -> DataFrame:
    """entries (dataset, entry_id, created_at, state, current, recovery_protected, byte_count) and protection: why each stays, or NULL where it may go.

    Checked in order: current; recovery; started; recent, within its days or the recovery window; minimum_committed, the
    newest committed ones. Entries of datasets without a rule stay as unmanaged. It only plans and removes nothing.
    """
    days, least = F.lit(None).cast("int"), F.lit(None).cast("int")
    for n, (d, k) in retention.items():
        days, least = F.when(F.col("dataset") == n, d).otherwise(days), F.when(F.col("dataset") == n, k).otherwise(least)
    committed = F.col("state") == "committed"
    newest = F.row_number().over(W.partitionBy("dataset", committed).orderBy(F.desc("created_at"), F.desc("entry_id")))
    seconds = F.unix_seconds("created_at") >= F.lit(int(captured_at.timestamp())) - F.greatest(days * 24, F.lit(recovery_hours)).cast("bigint") * 3600
    reason = (
        F.when(days.isNull(), "unmanaged")
        .when(F.coalesce("current", F.lit(False)), "current")
        .when(F.coalesce("recovery_protected", F.lit(False)), "recovery")
        .when(F.col("state") == "started", "started")
        .when(seconds, "recent")
        .when(committed & (F.col("_newest") <= least), "minimum_committed")
    )
    return entries.withColumn("_newest", newest).withColumn("protection", reason).drop("_newest")


def retention_findings(plan: DataFrame, captured_at: datetime, now: datetime, max_age_hours: int = 24, max_candidates: int = 500) -> list[str]:
    """What blocks a plan: an inventory of the future (by over five minutes) or too old, or more candidates than one run may have."""
    found = []
    if captured_at > now + timedelta(minutes=5):
        found.append("retention_inventory_capture_is_in_future")
    if captured_at < now - timedelta(hours=max_age_hours):
        found.append("retention_inventory_capture_is_stale")
    if plan.where("protection is null").limit(max_candidates + 1).count() > max_candidates:
        found.append("retention_candidate_count_exceeds_policy")
    return found
