"""History of changing attributes, rebuilt chain by chain.

A chain is all versions of one entity. When late or corrected evidence arrives, only the entities that it touches are
rebuilt, each from all of its raw evidence, and their chains replace the old ones as a whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.functions.reading import text_of

IDENTITY = ("client_id", "site_id", "model")


def usable_evidence(assignments: DataFrame) -> DataFrame:
    """event_date, machine_id, client_id, site_id, model (without surrounding blanks) and _ingested_at of the rows that have all five."""
    texts = ("machine_id", *IDENTITY)
    rows = assignments.select(F.col("event_date").cast("date").alias("event_date"), *[text_of(F.col(c)).alias(c) for c in texts], "_ingested_at")
    return rows.where(" and ".join(f"{c} is not null" for c in ("event_date", *texts)))


def _per_day(evidence: DataFrame) -> DataFrame:
    """One row per machine and day: its attributes, and whether evidence of that day disagrees. Repeats vanish before the shuffle."""
    attributes = F.struct(*IDENTITY)
    return evidence.groupBy("machine_id", "event_date").agg(F.min(attributes).alias("_a"), F.max(attributes).alias("_z")).withColumn("_disputed", F.col("_a") != F.col("_z"))


def disputed_machines(evidence: DataFrame) -> DataFrame:
    """machine_id of machines with two different attribute sets on one day."""
    return _per_day(evidence).where("_disputed").select("machine_id").distinct()


def build_chains(evidence: DataFrame) -> DataFrame:
    """machine_id, effective_from, effective_to, is_current, version, client_id, site_id, model of machines that aren't disputed.

    evidence is what usable_evidence gives. A version begins with the first evidence and wherever the attributes differ
    from the evidence before; it ends the day before the next begins, the last stays open (NULL). The machine's window
    holds a row per day, not per evidence row, so no machine can outgrow a task.
    """
    w = W.partitionBy("machine_id").orderBy("event_date")
    days = _per_day(evidence).withColumn("_any", F.max("_disputed").over(W.partitionBy("machine_id"))).where("not _any")
    starts = days.withColumn("_before", F.lag("_a").over(w)).where("_before is null or _before <> _a")
    following = F.lead("event_date").over(w)
    return starts.select(
        "machine_id",
        F.col("event_date").alias("effective_from"),
        F.date_sub(following, 1).alias("effective_to"),
        following.isNull().alias("is_current"),
        F.row_number().over(w).alias("version"),
        *[F.col(f"_a.{c}").alias(c) for c in IDENTITY],
    )


def rebuild_touched(history: DataFrame, evidence: DataFrame, touched: DataFrame) -> DataFrame:
    """history with the chains of the touched machines replaced by chains built from all their evidence.

    touched has machine_id; a touched machine without a chain any more (now disputed, evidence withdrawn) loses it.
    """
    keys = touched.select("machine_id").distinct()
    return history.join(keys, "machine_id", "left_anti").unionByName(build_chains(evidence.join(keys, "machine_id", "left_semi")))


def late(evidence: DataFrame, grace_days: int = 1) -> Column:
    """Evidence that became known more than grace_days after the day it is about, or at an unknown time."""
    return F.coalesce(evidence["_ingested_at"] >= F.timestamp_seconds((F.unix_date(evidence["event_date"]) + grace_days + 1) * F.lit(86_400)), F.lit(True))


def assignment_history(assignments: DataFrame) -> DataFrame:
    """The whole history: chains of the evidence that came in time, then those rebuilt that late evidence touches."""
    evidence = usable_evidence(assignments)
    is_late = late(evidence)
    return rebuild_touched(build_chains(evidence.where(~is_late)), evidence, evidence.where(is_late))


EVIDENCE = ("event_date", "machine_id", *IDENTITY, "assignment_evidence_source")


def named_sources(sources: Mapping[str, DataFrame], most: int = 20) -> DataFrame:
    """Evidence of several sources, of equal authority, each named by its key. Raises without a source, with too many, or with a name that is blank or longer than 64."""
    if not 1 <= len(sources) <= most:
        raise ValueError(f"from 1 to {most} sources are needed")
    for name in sources:
        if not isinstance(name, str) or not name.strip() or len(name) > 64:
            raise ValueError(f"no name for a source: {name!r}")
    parts = [sources[n].withColumn("assignment_evidence_source", F.lit(n.strip())) for n in sorted(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _evidence(assignments: DataFrame) -> DataFrame:
    texts = [text_of(F.col(c)).alias(c) for c in EVIDENCE[1:]]
    rows = assignments.select(F.col("event_date").cast("date").alias("event_date"), *texts)
    missing = F.lit(False)
    for c in EVIDENCE[:-1]:
        missing = missing | F.col(c).isNull()
    return rows.withColumn("_missing", missing)


def rejected_evidence(assignments: DataFrame) -> DataFrame:
    """The distinct evidence that makes no history: rows without a date or an identity, and all rows of a machine's day on which sources disagree."""
    rows = _evidence(assignments).distinct()
    usable = rows.where("not _missing")
    days = _per_day(usable).where("_disputed").select(F.col("machine_id").alias("_m"), F.col("event_date").alias("_d"))
    disputed = usable.join(days, (F.col("machine_id") == F.col("_m")) & (F.col("event_date") == F.col("_d")), "left_semi")
    return rows.where("_missing").unionByName(disputed).drop("_missing")


def evidence_findings(assignments: DataFrame) -> DataFrame:
    """finding, observed_count: rows without a date or an identity, a machine's days on which sources disagree, and what audit finds in the chains. Counts of 0 aren't listed."""
    rows = _evidence(assignments)
    missing = rows.agg(F.count_if("_missing").alias("observed_count")).select(F.lit("missing_assignment_identity").alias("finding"), "observed_count")
    days = _per_day(rows.where("not _missing")).agg(F.count_if("_disputed").alias("observed_count")).select(F.lit("same_day_assignment_conflict").alias("finding"), "observed_count")
    return missing.unionByName(days).unionByName(audit(assignment_history(assignments))).where("observed_count > 0")


def with_sources(chains: DataFrame, assignments: DataFrame) -> DataFrame:
    """chains with assignment_evidence_source_count: over a version's days, the sources that each day's evidence has, summed."""
    texts = ("machine_id", *IDENTITY)
    rows = assignments.select(F.col("event_date").cast("date").alias("_d"), *[text_of(F.col(c)).alias(c) for c in texts], text_of(F.col("assignment_evidence_source")).alias("_source"))
    days = rows.where(" and ".join(f"{c} is not null" for c in ("_d", *texts))).groupBy(F.col("machine_id").alias("_m"), "_d").agg(F.count_distinct("_source").alias("_n"))
    within = (F.col("machine_id") == F.col("_m")) & (F.col("_d") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("_d") <= F.col("effective_to")))
    joined = chains.join(days, within, "left")
    return joined.groupBy(*chains.columns).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("assignment_evidence_source_count"))


def resolve(events: DataFrame, chains: DataFrame) -> DataFrame:
    """events (with machine_id and event_date) and resolution_status, match_count, resolved_client_id, resolved_site_id, resolved_model.

    resolved: one version is in effect that day; unresolved: none; ambiguous: several, which audit would have told. No
    event is dropped or repeated: a machine's versions, bounded by its days, meet its events as one array.
    """
    version = F.struct("effective_from", "effective_to", *IDENTITY)
    versions = chains.groupBy(F.col("machine_id").alias("_m")).agg(F.collect_list(version).alias("_versions"))
    joined = events.join(versions, events["machine_id"] == F.col("_m"), "left")
    holds = lambda v: (v["effective_from"] <= F.col("event_date")) & (v["effective_to"].isNull() | (v["effective_to"] >= F.col("event_date")))
    matched = joined.withColumn("_match", F.coalesce(F.filter("_versions", holds), F.array().cast(joined.schema["_versions"].dataType)))
    n = F.size("_match")
    one = lambda c: F.when(n == 1, F.get("_match", F.lit(0))[c])
    return matched.select(
        *[events[c] for c in events.columns],
        F.when(n == 1, "resolved").when(n == 0, "unresolved").otherwise("ambiguous").alias("resolution_status"),
        n.alias("match_count"),
        *[one(c).alias(f"resolved_{c}") for c in IDENTITY],
    )


def audit(chains: DataFrame) -> DataFrame:
    """finding, observed_count of a history: blank identities, repeated grain, ranges that end before they begin or overlap, and machines without exactly one current version. One window, one aggregation."""
    w = W.partitionBy("machine_id").orderBy("effective_from", F.col("effective_to").asc_nulls_last())
    reach = F.max(F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    blank = F.lit(False)
    for c in ("machine_id", *IDENTITY):
        blank = blank | F.coalesce(F.trim(c) == "", F.lit(True))
    rows = chains.select(
        "machine_id",
        (blank | F.col("effective_from").isNull()).alias("identity"),
        (F.lag("effective_from").over(w) == F.col("effective_from")).alias("repeated"),
        (F.col("effective_to") < F.col("effective_from")).alias("backwards"),
        (F.col("effective_from") <= reach).alias("overlaps"),
        (F.col("is_current") == F.col("effective_to").isNull()).alias("flag_fits"),
        F.col("is_current").cast("int").alias("current"),
    )
    per_machine = rows.groupBy("machine_id").agg(
        *[F.count_if(c).alias(c) for c in ("identity", "repeated", "backwards", "overlaps")], F.count_if(~F.col("flag_fits")).alias("misfits"), F.sum("current").alias("current")
    )
    one = per_machine.agg(
        F.sum("repeated").alias("assignment_history_grain_duplicate"),
        F.sum("identity").alias("assignment_history_identity_missing"),
        F.sum("overlaps").alias("assignment_history_range_overlap"),
        F.count_if((F.col("current") != 1) | (F.col("misfits") > 0)).alias("assignment_history_current_member_invalid"),
        F.sum("backwards").alias("assignment_history_range_invalid"),
    )
    return one.unpivot([], one.columns, "finding", "observed_count").withColumn("observed_count", F.coalesce("observed_count", F.lit(0)))


class ChainStore:
    """Chains in buckets of entities on shared storage; a rebuild rewrites the touched buckets and shows them in one step.

    Every bucket version is written to a folder of its own; the state files `state-{n}.json` name the folder of each
    bucket, and the last one counts. A replacement shows by creating the next state file, which only one of several can:
    the others raise and lose nothing but their work. Readers see all old or all new chains. root is a path of any file
    system that Spark reads. The number of buckets is kept with the data. What no state names any more, sweep removes.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.root}/{name}")
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path(self.root))
        self.buckets = self._state()[1].get("buckets", buckets)

    def _state(self) -> tuple[int, dict]:
        """(number, content) of the last state; (0, {}) before the first replacement."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []
        number = max((int(n[6:-5]) for n in names if n.startswith("state-") and n.endswith(".json")), default=0)
        if not number:
            return 0, {}
        stream = self._fs.open(self._path(f"state-{number}.json"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("machine_id"), F.lit(self.buckets))

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts])

    def read(self) -> DataFrame | None:
        """The chains now in force; None before the first replacement, or where none is left."""
        parts = sorted(self._state()[1].get("parts", {}).values())
        return self._read(parts) if parts else None

    def replace(self, evidence: DataFrame, touched: DataFrame) -> None:
        """Rebuild the touched machines from evidence (all there is of them) and put their chains in force. Raises where another replacement came first."""
        number, state = self._state()
        now = dict(state.get("parts", {}))
        keys = touched.where("machine_id is not null").select("machine_id").distinct()
        hit = [str(r[0]) for r in keys.select(self._bucket()).distinct().collect()]  # at most self.buckets numbers
        rebuilt = build_chains(evidence.join(keys, "machine_id", "left_semi"))
        if old := [now[b] for b in hit if b in now]:
            rebuilt = self._read(old).join(keys, "machine_id", "left_anti").unionByName(rebuilt)
        run = f"run-{uuid.uuid4().hex}"
        rebuilt.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{run}")
        for b in hit:
            part = f"{run}/_bucket={b}"
            if self._fs.exists(self._path(part)):
                now[b] = part
            else:
                now.pop(b, None)
        self._show(number + 1, {"buckets": self.buckets, "parts": now})

    def _show(self, number: int, state: dict) -> None:
        draft, name = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"state-{number}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        # a rename onto a name that is there fails or is refused
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.root} was replaced meanwhile; read it again")

    def sweep(self) -> None:
        """Removes the runs and states that the last state doesn't name. For a time without readers of older states."""
        number, state = self._state()
        runs = {p.split("/")[0] for p in state.get("parts", {}).values()}
        for s in self._fs.listStatus(self._path("")):
            name = s.getPath().getName()
            if (name.startswith("run-") and name not in runs) or name.startswith("draft-") or (name.startswith("state-") and name != f"state-{number}.json"):
                self._fs.delete(s.getPath(), True)


def maintained_history(assignments: DataFrame, store: ChainStore) -> DataFrame:
    """assignment_history by way of a store: chains of the evidence that came in time are put in force, then those that late evidence touches are rebuilt from all their evidence and replaced at once."""
    evidence = usable_evidence(assignments)
    is_late = late(evidence)
    in_time = evidence.where(~is_late)
    store.replace(in_time, in_time)
    store.replace(evidence, evidence.where(is_late))
    chains = store.read()
    return build_chains(evidence.limit(0)) if chains is None else chains


def buckets_for(rows: int, per_bucket: int = 250_000) -> int:
    """How many buckets a store of the chains of so many rows of evidence has: a bucket is rewritten by one task."""
    return min(65_536, max(16, -(-rows // per_bucket)))
