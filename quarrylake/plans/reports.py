"""The reporting catalogue: each report is a function of the frames. Rows come unsorted; ORDER gives each report's order for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.marts import SEMANTICS, month_of, ratio, share, two, used_parts
from quarrylake.operators.star import natural
from quarrylake.plans.frames import Frames

SEGMENT = ("client_id", "site_id", "model")
ASSET = ("client_id", "site_id", "machine_id", "model")


def total(c: str | Column) -> Column:
    return F.sum(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)))


def hours(minutes: str) -> Column:
    return two(F.col(minutes) / F.lit(60.0).cast("double"))


def status(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first case that holds."""
    out = F.lit(otherwise)
    for when, name in reversed(cases):
        out = F.when(when, F.lit(name)).otherwise(out)
    return out


def join_same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """An equi-join in which a missing model equals a missing model. The keys come from the left."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) if k == "model" else F.col(k) == F.col(f"_r_{k}") for k in keys]
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def daily_uptime_by_site_model(f: Frames) -> DataFrame:
    return f.uptime.groupBy("event_date", "site_id", "model").agg(
        two(F.avg("uptime_pct")).alias("avg_uptime_pct"),
        F.sum("downtime_minutes").alias("attributed_downtime_minutes"),
        two(F.avg("downtime_load_pct")).alias("avg_downtime_load_pct"),
        F.count_if("downtime_exceeds_observed").alias("attributed_downtime_above_observation_count"),
        F.max("downtime_semantics_version").alias("downtime_semantics_version"),
        two(F.avg("avg_health_score")).alias("avg_health_score"),
    )


def machine_observation_continuity(f: Frames) -> DataFrame:
    days = f.uptime.groupBy(*ASSET, "event_date").agg(total("running_minutes").alias("run"), total("observed_minutes").alias("seen"))
    gap = F.datediff("event_date", F.lag("event_date").over(W.partitionBy(*ASSET).orderBy("event_date")))
    days = days.withColumn("gap", gap).withColumn("hole", F.greatest(F.col("gap") - 1, F.lit(0))).withColumn("hole", F.coalesce("hole", F.lit(0)))
    s = days.groupBy(*ASSET).agg(
        F.min("event_date").alias("first_observed_date"),
        F.max("event_date").alias("last_observed_date"),
        F.count("*").alias("observed_day_count"),
        F.count_if(F.col("gap") == 1).alias("consecutive_observation_pair_count"),
        F.count_if(F.col("hole") > 0).alias("observation_gap_count"),
        F.sum("hole").alias("unobserved_days_within_span"),
        F.max("hole").alias("max_unobserved_gap_days"),
        two(F.avg(F.when(F.col("hole") > 0, F.col("hole")))).alias("avg_unobserved_gap_days"),
        F.count_if(F.col("seen") <= 0).alias("no_observed_duration_day_count"),
        F.count_if(F.col("run") <= 0).alias("no_operating_time_day_count"),
        F.sum("run").alias("run"),
        F.sum("seen").alias("seen"),
    )
    span = F.datediff("last_observed_date", "first_observed_date") + 1
    return s.select(
        *[c for c in s.columns if c not in ("run", "seen")],
        span.alias("calendar_span_days"),
        share(F.col("observed_day_count"), span).alias("observed_day_coverage_pct"),
        hours("run").alias("operating_hours"),
        hours("seen").alias("observed_hours"),
        status(
            (F.col("seen") <= 0, "no_observed_duration"),
            (F.col("observed_day_count") == 1, "single_observed_day"),
            (F.col("observation_gap_count") == 0, "continuous_observed_dates"),
            otherwise="intermittent_observed_dates",
        ).alias("observation_continuity_status"),
        F.lit("observed_date_span_only").alias("continuity_scope"),
    )


def client_asset_summary(f: Frames) -> DataFrame:
    return f.summary


def machine_reliability_scorecard(f: Frames) -> DataFrame:
    s = f.days.groupBy(*ASSET).agg(
        F.min("event_date").alias("first_observed_date"),
        F.max("event_date").alias("last_observed_date"),
        F.sum("running_minutes").alias("run"),
        F.sum("observed_minutes").alias("seen"),
        F.sum("downtime_minutes").alias("attributed_downtime_minutes"),
        two(F.avg("uptime_pct")).alias("avg_uptime_pct"),
        two(F.avg("avg_health_score")).alias("avg_health_score"),
        F.sum("failure_event_count").alias("failure_event_count"),
        F.sum("failure_downtime_minutes").alias("lost"),
        two(F.sum("failure_cost_gbp")).alias("failure_related_cost_gbp"),
        F.max("latest_failure_at_utc").alias("latest_failure_at_utc"),
    )
    n = F.col("failure_event_count")
    return s.select(
        *ASSET,
        "first_observed_date",
        "last_observed_date",
        hours("run").alias("operating_hours"),
        hours("seen").alias("observed_hours"),
        "avg_uptime_pct",
        "avg_health_score",
        "attributed_downtime_minutes",
        n,
        F.when(F.col("run") > 0, two(n * 6000.0 / F.col("run"))).alias("failures_per_100_operating_hours"),
        ratio(F.col("lost"), n).alias("avg_attributed_downtime_per_failure_minutes"),
        ratio(F.col("failure_related_cost_gbp"), n).alias("avg_failure_related_cost_gbp"),
        "failure_related_cost_gbp",
        "latest_failure_at_utc",
        status((F.col("run") <= 0, "no_operating_time"), (n == 0, "no_recorded_failures"), otherwise="observed_failures").alias("reliability_observation_status"),
        F.lit(SEMANTICS).alias("downtime_semantics_version"),
    )


def _monthly(f: Frames) -> DataFrame:
    """What was observed and what failed by month, client, site and model. Machines come first, so that none needs a distinct count."""
    keys = (month_of(F.col("event_date")).alias("event_month"), *SEGMENT)
    machines = f.days.groupBy(*keys, "machine_id").agg(
        total("running_minutes").alias("run"),
        total("observed_minutes").alias("seen"),
        total("downtime_minutes").alias("down"),
        F.sum("avg_health_score").alias("health"),
        F.count("avg_health_score").alias("days"),
        F.sum("failure_event_count").alias("n"),
        F.sum("failure_downtime_minutes").alias("lost"),
        F.sum("failure_cost_gbp").alias("cost"),
    )
    return machines.groupBy("event_month", *SEGMENT).agg(
        F.count("*").alias("observed_machine_count"),
        F.sum("run").alias("run"),
        F.sum("seen").alias("seen"),
        F.sum("down").alias("attributed_downtime_minutes"),
        two(F.sum("health") / F.sum("days")).alias("avg_daily_machine_health_score"),
        F.first(F.lit(SEMANTICS)).alias("downtime_semantics_version"),
        F.sum("n").alias("failure_event_count"),
        F.count_if(F.col("n") > 0).alias("affected_machine_count"),
        F.sum("lost").alias("failure_attributed_downtime_minutes"),
        F.sum("cost").alias("cost"),
    )


def monthly_reliability_trends(f: Frames) -> DataFrame:
    m = _monthly(f).withColumns(
        {
            "operating_hours": hours("run"),
            "observed_hours": hours("seen"),
            "weighted_uptime_pct": share(F.col("run"), F.col("seen")),
            "failure_related_cost_gbp": two(F.col("cost")),
        }
    )
    w = W.partitionBy(*SEGMENT).orderBy("event_month")
    m = m.withColumn("previous_event_month", F.lag("event_month").over(w)).withColumn("_before", F.lag(F.struct(*m.columns)).over(w))
    consecutive = F.add_months("previous_event_month", 1) == F.col("event_month")
    change = lambda c: F.when(consecutive, F.col(c) - F.col(f"_before.{c}"))
    return m.select(
        "event_month",
        *SEGMENT,
        "observed_machine_count",
        "operating_hours",
        "observed_hours",
        "weighted_uptime_pct",
        "avg_daily_machine_health_score",
        "attributed_downtime_minutes",
        "downtime_semantics_version",
        "failure_event_count",
        "affected_machine_count",
        "failure_attributed_downtime_minutes",
        "failure_related_cost_gbp",
        "previous_event_month",
        status(
            (F.col("observed_hours") <= 0, "no_observed_duration"),
            (F.col("previous_event_month").isNull(), "first_observed_month"),
            (~consecutive, "non_consecutive_history"),
            otherwise="consecutive_comparison",
        ).alias("trend_status"),
        two(change("weighted_uptime_pct")).alias("weighted_uptime_pct_change"),
        change("failure_event_count").alias("failure_event_count_change"),
        change("attributed_downtime_minutes").alias("attributed_downtime_minutes_change"),
        two(change("failure_related_cost_gbp")).alias("failure_related_cost_change_gbp"),
    )


def maintenance_cost_drivers(f: Frames) -> DataFrame:
    keys = ("event_month", *SEGMENT)
    costs = f.costs.groupBy(*keys).agg(
        F.sum("maintenance_event_count").alias("maintenance_event_count"),
        F.sum("failure_event_count").alias("failure_event_count"),
        two(total("maintenance_cost_gbp")).alias("maintenance_cost_gbp"),
        total("downtime_minutes").alias("attributed_downtime_minutes"),
    )
    parts = f.parts.groupBy(month_of(F.col("event_date")).alias("event_month"), *SEGMENT, "part_code").agg(
        F.sum("part_quantity").alias("q"), two(total("associated_cost_gbp")).alias("c")
    )
    # the part with the largest (quantity, cost), of equals the first by code
    order = F.struct(-F.col("q"), -F.col("c"), "part_code")
    top = parts.groupBy(*keys).agg(F.min_by(F.struct("part_code", "q", "c"), order).alias("top"))
    s = join_same(costs, top, keys)
    cost, fail, maint = F.col("maintenance_cost_gbp"), F.col("failure_event_count"), F.col("maintenance_event_count")
    return s.select(
        *costs.columns,
        ratio(cost, maint).alias("cost_per_maintenance_event_gbp"),
        ratio(cost, fail).alias("cost_per_failure_event_gbp"),
        ratio(F.col("attributed_downtime_minutes"), fail).alias("attributed_downtime_per_failure_minutes"),
        F.col("top.part_code").alias("top_recorded_part_code"),
        F.col("top.q").alias("top_recorded_part_quantity"),
        F.col("top.c").alias("top_recorded_part_cost_gbp"),
        share(F.col("top.c"), cost).alias("top_recorded_part_cost_share_pct"),
        status(
            ((maint == 0) & (fail == 0) & (cost == 0) & (F.col("attributed_downtime_minutes") == 0), "no_recorded_maintenance_impact"),
            (fail == 0, "maintenance_without_recorded_failure"),
            (F.col("top.part_code").isNull(), "failure_without_recorded_part"),
            otherwise="failure_with_recorded_part",
        ).alias("maintenance_observation_status"),
    )


def site_reliability_benchmark(f: Frames) -> DataFrame:
    peers = W.partitionBy("event_month", "client_id", "model")
    per = lambda what, factor, run: F.when(F.col(run) > 0, two(F.col(what) * factor / F.col(run)))
    m = _monthly(f)
    m = m.withColumns({f"all_{c}": F.sum(c).over(peers) for c in ("run", "seen", "failure_event_count", "cost")})
    m = m.withColumns(
        {
            "benchmark_site_row_count": F.count("*").over(peers),
            "comparable_observed_site_count": F.count_if(F.col("seen") > 0).over(peers),
            "comparable_operating_site_count": F.count_if(F.col("run") > 0).over(peers),
            "weighted_uptime_pct": share(F.col("run"), F.col("seen")),
            "client_model_weighted_uptime_pct": share(F.col("all_run"), F.col("all_seen")),
            "failure_events_per_100_operating_hours": per("failure_event_count", 6000.0, "run"),
            "client_model_failure_events_per_100_operating_hours": per("all_failure_event_count", 6000.0, "all_run"),
            "failure_related_cost_per_operating_hour_gbp": per("cost", 60.0, "run"),
            "client_model_failure_related_cost_per_operating_hour_gbp": per("all_cost", 60.0, "all_run"),
        }
    )
    rank = F.row_number().over(
        peers.orderBy(
            F.col("weighted_uptime_pct").desc_nulls_last(),
            F.col("failure_events_per_100_operating_hours").asc_nulls_last(),
            F.col("failure_related_cost_per_operating_hour_gbp").asc_nulls_last(),
            "site_id",
        )
    )
    versus = lambda c: two(F.col(c) - F.col(f"client_model_{c}"))
    return m.select(
        "event_month",
        *SEGMENT,
        "observed_machine_count",
        hours("run").alias("operating_hours"),
        hours("seen").alias("observed_hours"),
        "weighted_uptime_pct",
        "client_model_weighted_uptime_pct",
        versus("weighted_uptime_pct").alias("weighted_uptime_pct_vs_client_model"),
        "failure_event_count",
        "affected_machine_count",
        "failure_events_per_100_operating_hours",
        "client_model_failure_events_per_100_operating_hours",
        versus("failure_events_per_100_operating_hours").alias("failure_rate_vs_client_model"),
        two(F.col("cost")).alias("failure_related_cost_gbp"),
        "failure_related_cost_per_operating_hour_gbp",
        "client_model_failure_related_cost_per_operating_hour_gbp",
        versus("failure_related_cost_per_operating_hour_gbp").alias("cost_rate_vs_client_model_gbp"),
        "attributed_downtime_minutes",
        "failure_attributed_downtime_minutes",
        "downtime_semantics_version",
        "benchmark_site_row_count",
        "comparable_observed_site_count",
        "comparable_operating_site_count",
        rank.alias("site_comparison_rank"),
        status(
            (F.col("seen") <= 0, "site_has_no_observed_duration"),
            (F.col("run") <= 0, "site_has_no_operating_time"),
            (F.col("comparable_observed_site_count") < 2, "single_observed_site_reference"),
            otherwise="multi_site_comparison",
        ).alias("benchmark_status"),
    )


def _failure_facts(f: Frames) -> DataFrame:
    """All failure events with natural keys, those of machines on unsettled days too: as many as the failure mart has."""
    return natural(f.star, "fact_machine_failure_event")


FAULT = ("fault_code", "severity", "severity_rank")


def failure_events_by_fault(f: Frames) -> DataFrame:
    return _failure_facts(f).groupBy("event_date", *SEGMENT, *FAULT).agg(
        F.sum("failure_event_count").alias("failure_event_count"),
        F.count_distinct("machine_id").alias("affected_machine_count"),
        F.sum("downtime_minutes").alias("downtime_minutes"),
        two(F.sum("maintenance_cost_gbp")).alias("maintenance_cost_gbp"),
    )


def _recurrence(events: DataFrame, keys: tuple[str, ...], extra: dict[str, Column]) -> DataFrame:
    """How often and on which days something recurred by keys: one row per key and day first, so that days, months and intervals need no distinct."""
    days = events.groupBy(*keys, "event_date").agg(
        F.sum("failure_event_count").alias("n"),
        F.count_distinct("event_id").alias("ids"),
        F.min("event_ts_utc").alias("t0"),
        F.max("event_ts_utc").alias("t1"),
        *[F.sum(c).alias(n) for n, c in extra.items()],
    )
    w = W.partitionBy(*keys).orderBy("event_date")
    days = days.withColumn("gap", F.datediff("event_date", F.lag("event_date").over(w)))
    month = month_of(F.col("event_date"))
    days = days.withColumn("new_month", F.when(F.lag(month).over(w).eqNullSafe(month), 0).otherwise(1))
    return days.groupBy(*keys).agg(
        F.min("event_date").alias("first"),
        F.max("event_date").alias("latest"),
        F.min("t0").alias("first_at"),
        F.max("t1").alias("latest_at"),
        F.sum("n").alias("n"),
        F.sum("ids").alias("ids"),
        F.count("*").alias("days"),
        F.sum("new_month").alias("months"),
        F.count("gap").alias("intervals"),
        F.min("gap").alias("min_gap"),
        two(F.avg("gap")).alias("avg_gap"),
        F.max("gap").alias("max_gap"),
        *[F.sum(n).alias(n) for n in extra],
    )


def _repeat_status(word: str) -> Column:
    part = "part_" if word == "part" else ""
    return status(
        (F.col("n") <= 1, f"single_observed_{word}_event"),
        (F.col("days") == 1, f"repeat_{part}events_on_one_observed_day"),
        (F.col("months") == 1, f"repeat_{part}events_across_observed_days"),
        otherwise=f"repeat_{part}events_across_observed_months",
    )


def machine_fault_recurrence(f: Frames) -> DataFrame:
    keys = (*ASSET, *FAULT)
    r = _recurrence(_failure_facts(f), keys, {"down": F.coalesce("downtime_minutes", F.lit(0)), "cost": F.coalesce("maintenance_cost_gbp", F.lit(0))})
    r = r.withColumn("cost", two(F.col("cost")))
    d = lambda c: F.col(c).desc()
    rank = F.row_number().over(W.partitionBy(*SEGMENT).orderBy(d("n"), d("days"), d("down"), d("cost"), d("severity_rank"), "machine_id", "fault_code", "severity"))
    return r.select(
        *keys,
        rank.alias("observed_recurrence_rank"),
        F.col("first").alias("first_observed_failure_date"),
        F.col("latest").alias("latest_observed_failure_date"),
        F.col("first_at").alias("first_observed_failure_at_utc"),
        F.col("latest_at").alias("latest_observed_failure_at_utc"),
        F.col("n").alias("observed_failure_event_count"),
        F.col("ids").alias("observed_failure_identity_count"),
        F.greatest(F.col("n") - 1, F.lit(0)).alias("repeat_observed_failure_event_count"),
        F.col("days").alias("observed_failure_day_count"),
        F.col("months").alias("observed_failure_month_count"),
        (F.datediff("latest", "first") + 1).alias("observed_failure_calendar_span_days"),
        F.col("intervals").alias("recurrence_interval_observation_count"),
        F.col("min_gap").alias("min_days_between_observed_failure_days"),
        F.col("avg_gap").alias("avg_days_between_observed_failure_days"),
        F.col("max_gap").alias("max_days_between_observed_failure_days"),
        F.col("down").alias("attributed_downtime_minutes"),
        F.col("cost").alias("failure_related_cost_gbp"),
        ratio(F.col("down"), F.col("n")).alias("avg_attributed_downtime_per_failure_event_minutes"),
        ratio(F.col("cost"), F.col("n")).alias("avg_failure_related_cost_per_event_gbp"),
        _repeat_status("failure").alias("observed_recurrence_status"),
        F.lit("observed_failure_events_only").alias("recurrence_scope"),
    )


def machine_part_usage_recurrence(f: Frames) -> DataFrame:
    keys = (*ASSET, *FAULT, "part_code")
    none = lambda c: F.coalesce(c, F.lit(0))
    r = _recurrence(used_parts(_failure_facts(f)), keys, {"q": none("part_quantity"), "down": none("downtime_minutes"), "cost": none("maintenance_cost_gbp")})
    r = r.withColumn("cost", two(F.col("cost")))
    d = lambda c: F.col(c).desc()
    rank = F.row_number().over(W.partitionBy(*SEGMENT).orderBy(d("q"), d("n"), d("cost"), d("severity_rank"), "machine_id", "fault_code", "part_code", "severity"))
    return r.select(
        *keys,
        rank.alias("observed_part_usage_rank"),
        F.col("first").alias("first_observed_part_use_date"),
        F.col("latest").alias("latest_observed_part_use_date"),
        F.col("first_at").alias("first_observed_part_use_at_utc"),
        F.col("latest_at").alias("latest_observed_part_use_at_utc"),
        F.col("n").alias("observed_part_event_count"),
        F.col("ids").alias("observed_part_identity_count"),
        F.greatest(F.col("n") - 1, F.lit(0)).alias("repeat_observed_part_event_count"),
        F.col("days").alias("observed_part_day_count"),
        F.col("months").alias("observed_part_month_count"),
        (F.datediff("latest", "first") + 1).alias("observed_part_use_calendar_span_days"),
        F.col("intervals").alias("recurrence_interval_observation_count"),
        F.col("min_gap").alias("min_days_between_observed_part_use_dates"),
        F.col("avg_gap").alias("avg_days_between_observed_part_use_dates"),
        F.col("max_gap").alias("max_days_between_observed_part_use_dates"),
        F.col("q").alias("total_recorded_part_quantity"),
        ratio(F.col("q"), F.col("n")).alias("avg_recorded_part_quantity_per_event"),
        F.col("down").alias("associated_attributed_downtime_minutes"),
        ratio(F.col("down"), F.col("n")).alias("avg_associated_downtime_per_part_event_minutes"),
        F.col("cost").alias("associated_failure_cost_gbp"),
        ratio(F.col("cost"), F.col("n")).alias("avg_associated_failure_cost_per_part_event_gbp"),
        _repeat_status("part").alias("part_usage_recurrence_status"),
        F.lit("observed_failure_part_records_only").alias("part_usage_scope"),
    )


def _concentration(df: DataFrame, measures: dict[str, str], order: list[Column]) -> DataFrame:
    """Totals, shares and cumulative shares of measures within month and segment, in one sort. measures maps each to the prefix of its shares."""
    group = W.partitionBy("event_month", *SEGMENT)
    up_to = group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({f"_t_{m}": F.sum(m).over(group) for m in measures} | {f"_c_{m}": F.sum(m).over(up_to) for m in measures})
    return df.withColumns(
        {f"total_{m}": F.col(f"_t_{m}") for m in measures}
        | {f"{p}_share_pct": share(F.col(m), F.col(f"_t_{m}")) for m, p in measures.items()}
        | {f"cumulative_{p}_share_pct": share(F.col(f"_c_{m}"), F.col(f"_t_{m}")) for m, p in measures.items()}
        | {"_rank": F.row_number().over(group.orderBy(*order))}
    ).drop(*[f"_{x}_{m}" for x in "tc" for m in measures])


def monthly_part_usage_concentration(f: Frames) -> DataFrame:
    """Which parts a segment's failures used in a month. A machine with several versions in the month counts once."""
    parts = used_parts(_failure_facts(f)).groupBy(month_of(F.col("event_date")).alias("event_month"), *SEGMENT, "part_code").agg(
        F.sum("failure_event_count").alias("observed_part_event_count"),
        F.count_distinct("event_id").alias("observed_part_identity_count"),
        F.count_distinct("machine_id").alias("affected_machine_count"),
        F.count_distinct("date_key").alias("observed_part_day_count"),
        F.count_distinct("fault_key").alias("associated_fault_count"),
        total("part_quantity").alias("recorded_part_quantity"),
        total("downtime_minutes").alias("associated_attributed_downtime_minutes"),
        two(total("maintenance_cost_gbp")).alias("associated_failure_cost_gbp"),
    )
    order = [F.col(c).desc() for c in ("recorded_part_quantity", "observed_part_event_count", "associated_failure_cost_gbp", "associated_attributed_downtime_minutes")]
    shares = {
        "recorded_part_quantity": "recorded_part_quantity",
        "observed_part_event_count": "observed_part_event",
        "associated_attributed_downtime_minutes": "associated_attributed_downtime",
        "associated_failure_cost_gbp": "associated_failure_cost",
    }
    c = _concentration(parts, shares, [*order, F.col("part_code")])
    cost, down = F.col("total_associated_failure_cost_gbp"), F.col("total_associated_attributed_downtime_minutes")
    return c.withColumns(
        {
            "recorded_part_count": F.count("*").over(W.partitionBy("event_month", *SEGMENT)),
            "part_usage_evidence_status": status(
                ((down <= 0) & (cost <= 0), "part_quantity_without_recorded_impact"),
                (cost <= 0, "part_quantity_without_recorded_cost"),
                otherwise="part_usage_evidence_observed",
            ),
            "part_usage_scope": F.lit("observed_failure_part_records_only"),
        }
    ).withColumnRenamed("_rank", "part_usage_rank")


def fault_impact_concentration(f: Frames) -> DataFrame:
    """Which faults a segment's failures come from in a month. A machine with several versions in the month counts once."""
    faults = _failure_facts(f).groupBy(month_of(F.col("event_date")).alias("event_month"), *SEGMENT, *FAULT).agg(
        F.sum("failure_event_count").alias("failure_event_count"),
        F.count_distinct("machine_id").alias("affected_machine_count"),
        total("downtime_minutes").alias("attributed_downtime_minutes"),
        two(total("maintenance_cost_gbp")).alias("maintenance_cost_gbp"),
    )
    # severity decides between equals of one code, so that ranks don't depend on chance
    order = [F.col(c).desc() for c in ("failure_event_count", "attributed_downtime_minutes", "maintenance_cost_gbp", "severity_rank")]
    shares = {"failure_event_count": "failure_event", "attributed_downtime_minutes": "attributed_downtime", "maintenance_cost_gbp": "maintenance_cost"}
    c = _concentration(faults, shares, [*order, F.col("fault_code"), F.col("severity")])
    n, down, cost = F.col("total_failure_event_count"), F.col("total_attributed_downtime_minutes"), F.col("total_maintenance_cost_gbp")
    return c.withColumn(
        "impact_evidence_status",
        status(
            (n <= 0, "no_recorded_failures"),
            ((down <= 0) & (cost <= 0), "failures_without_recorded_impact"),
            (cost <= 0, "failures_without_recorded_cost"),
            otherwise="failure_impact_observed",
        ),
    ).withColumnRenamed("_rank", "fault_impact_rank")


def costliest_failures(f: Frames) -> DataFrame:
    return f.failures.select("event_date", "site_id", "client_id", "machine_id", "model", "fault_code", "severity", "downtime_minutes", "maintenance_cost_gbp", "event_id")


def maintenance_cost_by_month_model(f: Frames) -> DataFrame:
    return f.costs.groupBy("event_month", "site_id", "model").agg(
        F.sum("maintenance_event_count").alias("maintenance_events"),
        F.sum("failure_event_count").alias("failure_events"),
        two(F.sum("maintenance_cost_gbp")).alias("maintenance_cost_gbp"),
        F.sum("downtime_minutes").alias("downtime_minutes"),
    )


def parts_usage_by_site(f: Frames) -> DataFrame:
    return f.parts.groupBy("event_date", "site_id", "part_code").agg(
        F.sum("part_quantity").alias("part_quantity"),
        two(F.sum("associated_cost_gbp")).alias("associated_cost_gbp"),
        F.sum("machine_count").alias("impacted_machine_count"),
    )


REPORTS = (
    daily_uptime_by_site_model, machine_observation_continuity, client_asset_summary, machine_reliability_scorecard,
    monthly_reliability_trends, maintenance_cost_drivers, site_reliability_benchmark, failure_events_by_fault,
    machine_fault_recurrence, machine_part_usage_recurrence, monthly_part_usage_concentration, fault_impact_concentration,
    costliest_failures, maintenance_cost_by_month_model, parts_usage_by_site,
)


def ordered(name: str, df: DataFrame) -> DataFrame:
    """A report in the order in which it is read."""
    d, a, last = (lambda c: F.col(c).desc()), F.col, (lambda c: F.col(c).desc_nulls_last())
    orders = {
        "daily_uptime_by_site_model": [a("event_date"), a("site_id"), a("model")],
        "machine_observation_continuity": [F.col("observed_day_coverage_pct").asc_nulls_last(), d("max_unobserved_gap_days"), d("no_observed_duration_day_count"), *map(a, ASSET)],
        "client_asset_summary": [a("client_id"), a("site_id"), d("failure_related_cost_gbp")],
        "machine_reliability_scorecard": [last("failures_per_100_operating_hours"), d("failure_related_cost_gbp"), a("client_id"), a("site_id"), a("machine_id")],
        "monthly_reliability_trends": [d("event_month"), d("failure_event_count"), d("attributed_downtime_minutes"), *map(a, SEGMENT)],
        "maintenance_cost_drivers": [d("maintenance_cost_gbp"), d("attributed_downtime_minutes"), d("event_month"), *map(a, SEGMENT)],
        "site_reliability_benchmark": [d("event_month"), a("client_id"), a("model"), a("site_comparison_rank"), a("site_id")],
        "failure_events_by_fault": [d("event_date"), d("severity_rank"), d("maintenance_cost_gbp")],
        "machine_fault_recurrence": [*map(a, SEGMENT), a("observed_recurrence_rank")],
        "machine_part_usage_recurrence": [*map(a, SEGMENT), a("observed_part_usage_rank")],
        "monthly_part_usage_concentration": [d("event_month"), *map(a, SEGMENT), a("part_usage_rank")],
        "fault_impact_concentration": [d("event_month"), *map(a, SEGMENT), a("fault_impact_rank")],
        "costliest_failures": [d("maintenance_cost_gbp"), d("downtime_minutes")],
        "maintenance_cost_by_month_model": [a("event_month"), d("maintenance_cost_gbp")],
        "parts_usage_by_site": [a("event_date"), d("associated_cost_gbp")],
    }
    return df.orderBy(*orders[name])
