"""Queries over the landed tables, each through its problem's operator, with production parameters on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions.reading import day_of
from quarrylake.functions.staging import shared_folder
from quarrylake.operators import anomalies, asof, delivery, history, intervals, malformed, rolling
from quarrylake.operators.trusted import contradicting_ids, landed_times, trusted_events


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _table(spark, sf_dir, "sample_machine_events")
    events = trusted_events(landed, "duration_minutes", "downtime_minutes")
    return intervals.periods_and_gaps(events, times=landed_times(landed)).where("kind <> 'report'")


def p2_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _table(spark, sf_dir, "sample_machine_events")
    return anomalies.implausible_readings(trusted_events(landed, *anomalies.READINGS), times=landed_times(landed))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_states(spark, sf_dir).select("event_id", "reading_field")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "sample_machine_events")
    judged = delivery.judge_deliveries(events, "event_id", ["_ingested_at", "record_id"])
    return judged.where("again").join(contradicting_ids(events), "event_id", "left_anti").select("event_id", "record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    assignments = _table(spark, sf_dir, "machine_assignments")
    store = history.ChainStore(spark, f"{shared_folder(spark)}/chains-{uuid.uuid4().hex}", history.buckets_for(assignments.count()))
    chains = history.maintained_history(assignments, store)
    return chains.select("machine_id", F.date_format("effective_from", "yyyy-MM-dd").alias("effective_from"), "client_id", "site_id", "model")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = history.usable_evidence(_table(spark, sf_dir, "machine_assignments"))
    landed = _table(spark, sf_dir, "sample_machine_events")
    events = trusted_events(landed, "site_id")
    events = events.join(history.disputed_machines(evidence), "machine_id", "left_anti")
    known = asof.as_known(events, evidence, "site_id", times=landed_times(landed))
    return known.where("known_site_id is not null and not (site_id <=> known_site_id)").select("event_id", F.col("known_site_id").alias("site_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.unreadable(_table(spark, sf_dir, "landed_lines"), _table(spark, sf_dir, "sample_machine_events"))


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = malformed.loaded(_table(spark, sf_dir, "landed_lines"), _table(spark, sf_dir, "sample_machine_events"))
    return events.withColumn("event_ts", F.date_format(F.to_utc_timestamp("event_ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = trusted_events(_table(spark, sf_dir, "sample_machine_events"), "downtime_minutes")
    amounts = events.select("machine_id", day_of(F.col("epoch_s")).alias("activity_day"), "downtime_minutes")
    return rolling.trailing_totals(amounts, "machine_id", "activity_day", "downtime_minutes")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _totals(spark, sf_dir).where("total_7d >= 360 and total_7d * 2 >= total_30d")
    return cases.select("machine_id", F.date_format("activity_day", "yyyy-MM-dd").alias("activity_day"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _totals(spark, sf_dir).withColumn("activity_day", F.date_format("activity_day", "yyyy-MM-dd"))
    return totals.withColumns({c: F.col(c).cast("double") for c in ("total_7d", "total_30d")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_states, p3_found, p4_found, p5_found, p6_found, p6_loaded, p7_found, p7_totals)
}
