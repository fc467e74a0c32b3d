"""Star schema over the marts: dimensions, facts, the view back to natural keys, and its audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.marts import share
from quarrylake.operators.medallion import blank

PLACE = ("site_id", "client_id", "model")
#: How severities rank; any other ranks 0.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def day_key(day: str) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def observations(uptime: DataFrame, failures: DataFrame) -> DataFrame:
    """Days on which a machine was seen with attributes."""
    return uptime.select("event_date", "machine_id", *PLACE).unionByName(failures.select("event_date", "machine_id", *PLACE)).distinct()


def unsettled_days(seen: DataFrame) -> DataFrame:
    """machine_id, event_date, attribute_sets, lacks_attribute of machine-days with several sets of attributes or without one of them."""
    lacking = F.lit(False)
    for c in ("machine_id", *PLACE):
        lacking = lacking | blank(F.col(c))
    days = seen.groupBy("machine_id", "event_date").agg(F.count("*").alias("attribute_sets"), F.max(lacking).alias("lacks_attribute"))
    return days.where("attribute_sets > 1 or lacks_attribute")


def unsettled_machines(seen: DataFrame) -> DataFrame:
    """machine_id of machines that lack an attribute, or have two sets of them, on some day."""
    return unsettled_days(seen).select("machine_id").distinct()


def _hash(*names: str) -> Column:
    """64 bits over columns. A NULL counts by its place: xxhash64 alone skips it."""
    return F.xxhash64(*[c for n in names for c in (F.col(n), F.col(n).isNull())])


def machine_versions(seen: DataFrame) -> DataFrame:
    """dim_machine: versions begin where a machine's attributes differ from the day seen before, one for each set of them that the day has.

    Versions of one machine overlap only where its days have several sets; is_ambiguous marks these. A missing attribute stays NULL.
    """
    w = W.partitionBy("machine_id").orderBy("event_date")
    days = seen.groupBy("machine_id", "event_date").agg(F.sort_array(F.collect_set(F.struct(*PLACE))).alias("_sets"))
    before = days.withColumn("_before", F.lag("_sets").over(w))
    starts = before.where(F.col("_before").isNull() | ~F.col("_sets").eqNullSafe(F.col("_before"))).withColumn("_next", F.lead("event_date").over(w))
    runs = starts.select("machine_id", "event_date", "_next", (F.size("_sets") > 1).alias("is_ambiguous"), F.explode("_sets").alias("_set"))
    sets = runs.select("machine_id", "event_date", "_next", "is_ambiguous", *[F.col(f"_set.{c}").alias(c) for c in PLACE])
    return sets.select(
        _hash("machine_id", "event_date", *PLACE).alias("machine_key"),
        "machine_id",
        *PLACE,
        F.row_number().over(W.partitionBy("machine_id").orderBy("event_date", *PLACE)).alias("assignment_version"),
        F.col("event_date").alias("valid_from_date"),
        F.date_sub("_next", 1).alias("valid_to_date"),
        F.col("_next").isNull().alias("is_current"),
        "is_ambiguous",
    )


def calendar(first_last: DataFrame) -> DataFrame:
    """dim_date: every day from first to last."""
    days = first_last.select(F.explode(F.sequence("first", "last")).alias("date_day"))
    text = lambda pattern: F.date_format("date_day", pattern)
    return days.select(
        day_key("date_day").alias("date_key"),
        "date_day",
        F.year("date_day").alias("year"),
        F.quarter("date_day").alias("quarter"),
        F.month("date_day").alias("month"),
        text("MMMM").alias("month_name"),
        text("yyyyMM").cast("int").alias("year_month_key"),
        text("yyyy-MM").alias("year_month"),
        F.dayofmonth("date_day").alias("day_of_month"),
        F.dayofweek("date_day").alias("day_of_week"),
        text("EEEE").alias("day_name"),
        F.weekofyear("date_day").alias("week_of_year"),
        F.dayofweek("date_day").isin(1, 7).alias("is_weekend"),
    )


def _with_version(source: DataFrame, machines: DataFrame) -> DataFrame:
    """source with the machine_key of the version with its attributes that is valid on its day: a range within each machine's few versions."""
    names = ("machine_id", *PLACE)
    m = machines.select(*[F.col(c).alias(f"_{c}") for c in names], "machine_key", "valid_from_date", "valid_to_date")
    on = F.col("event_date") >= F.col("valid_from_date")
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    on = on & (F.col("valid_to_date").isNull() | (F.col("event_date") <= F.col("valid_to_date")))
    return source.join(m, on, "left").drop(*[f"_{c}" for c in names], "valid_from_date", "valid_to_date")


def _keys() -> list[Column]:
    return [
        day_key("event_date").alias("date_key"),
        _hash("client_id").alias("client_key"),
        "machine_key",
        _hash("model").alias("model_key"),
        _hash("client_id", "site_id").alias("site_key"),
    ]


@dataclass(frozen=True)
class Star:
    dim_client: DataFrame
    dim_date: DataFrame
    dim_fault: DataFrame
    dim_machine: DataFrame
    dim_model: DataFrame
    dim_site: DataFrame
    fact_machine_failure_event: DataFrame
    fact_machine_uptime_daily: DataFrame


def build_star(uptime: DataFrame, failures: DataFrame) -> Star:
    """The star of every row of the marts. No identity is invented: a missing attribute is a member of its own, NULL.

    Days on which a machine's attributes aren't settled are for is_ambiguous and unsettled_days to tell.
    """
    seen = observations(uptime, failures)
    machines = machine_versions(seen)
    minutes = ("running_minutes", "idle_minutes", "maintenance_minutes", "downtime_minutes", "observed_minutes")
    percent = {"idle_pct": "idle_minutes", "maintenance_pct": "maintenance_minutes"}
    daily = _with_version(uptime, machines).select(
        _hash("event_date", "machine_id", *PLACE).alias("uptime_fact_key"),
        "event_date",
        *_keys(),
        *minutes,
        "uptime_pct",
        *[share(F.col(c), F.col("observed_minutes")).alias(n) for n, c in percent.items()],
        "avg_health_score",
        "downtime_load_pct",
        F.col("downtime_load_pct").alias("downtime_pct"),
        "downtime_exceeds_observed",
        "downtime_semantics_version",
    )
    events = _with_version(failures, machines).select(
        F.xxhash64("event_id").alias("failure_fact_key"),
        "event_id",
        "event_date",
        "event_ts_utc",
        *_keys(),
        _hash("fault_code", "severity").alias("fault_key"),
        F.lit(1).alias("failure_event_count"),
        "temperature_c",
        "vibration_mm_s",
        "downtime_minutes",
        "maintenance_cost_gbp",
        "part_code",
        "part_quantity",
    )
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    faults = failures.select("fault_code", "severity").distinct()
    return Star(
        dim_client=seen.select("client_id").distinct().select(_hash("client_id").alias("client_key"), "client_id"),
        dim_date=calendar(seen.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))),
        dim_fault=faults.select(_hash("fault_code", "severity").alias("fault_key"), "fault_code", "severity", rank.alias("severity_rank")),
        dim_machine=machines,
        dim_model=seen.select("model").distinct().select(_hash("model").alias("model_key"), "model"),
        dim_site=seen.select("site_id", "client_id").distinct().select(_hash("client_id", "site_id").alias("site_key"), "site_id", "client_id"),
        fact_machine_failure_event=events,
        fact_machine_uptime_daily=daily,
    )


#: Each foreign key: its dimension and what of it identifies the member.
FOREIGN = {
    "date_key": ("dim_date", ("date_day",)),
    "client_key": ("dim_client", ("client_id",)),
    "site_key": ("dim_site", ("site_id",)),
    "machine_key": ("dim_machine", ("machine_id",)),
    "model_key": ("dim_model", ("model",)),
    "fault_key": ("dim_fault", ("fault_code", "severity", "severity_rank")),
}


def natural(star: Star, fact: str) -> DataFrame:
    """A fact's rows with natural keys in place of surrogate ones; rows without a member in some dimension are left out. Dimensions broadcast by their size."""
    df = getattr(star, fact)
    for key, (dim, names) in FOREIGN.items():
        if key in df.columns:
            df = df.join(getattr(star, dim).select(key, *names), key)
    return df.drop("event_date").withColumnRenamed("date_day", "event_date")


def audit(star: Star, uptime: DataFrame, failures: DataFrame) -> DataFrame:
    """finding, dataset, detail, observed_count of the facts against their sources and dimensions, in a pass over each fact.

    Sources count whole, whatever the star leaves out. A count of 0 is no finding and not listed.
    """
    parts = []
    for fact, source, grain in (
        ("fact_machine_uptime_daily", uptime, ("date_key", "machine_key")),
        ("fact_machine_failure_event", failures, ("event_id",)),
    ):
        rows = getattr(star, fact)
        keys = [k for k in FOREIGN if k in rows.columns]
        for k in keys:
            members = getattr(star, FOREIGN[k][0]).select(F.col(k).alias(f"_{k}")).distinct().withColumn(f"_has_{k}", F.lit(True))
            rows = rows.join(members, rows[k] == F.col(f"_{k}"), "left")
        per_grain = rows.groupBy(*grain).agg(
            F.count("*").alias("n"),
            *[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys if k not in grain],
            *[F.count_if(F.col(k).isNotNull() & F.col(f"_has_{k}").isNull()).alias(f"lost_{k}") for k in keys],
        )
        null = lambda k: F.sum(F.when(F.col(k).isNull(), F.col("n")).otherwise(0)) if k in grain else F.sum(f"null_{k}")  # noqa: B023, E731
        one = per_grain.agg(
            F.sum("n").alias("rows"),
            F.sum(F.col("n") - 1).alias("repeats"),
            *[null(k).alias(f"null_{k}") for k in keys],
            *[F.sum(f"lost_{k}").alias(f"lost_{k}") for k in keys],
        ).crossJoin(F.broadcast(source.agg(F.count("*").alias("expected"))))  # one row each
        found = [
            F.struct(F.lit("source_fact_count_mismatch").alias("finding"), F.lit("").alias("detail"), F.abs(F.coalesce("rows", F.lit(0)) - F.col("expected")).alias("observed_count")),
            F.struct(F.lit("duplicate_fact_grain").alias("finding"), F.lit("").alias("detail"), F.col("repeats").alias("observed_count")),
            *[F.struct(F.lit("null_dimension_key").alias("finding"), F.lit(k).alias("detail"), F.col(f"null_{k}").alias("observed_count")) for k in keys],
            *[F.struct(F.lit("unmatched_dimension_key").alias("finding"), F.lit(k).alias("detail"), F.col(f"lost_{k}").alias("observed_count")) for k in keys],
        ]
        parts.append(one.select(F.lit(fact).alias("dataset"), F.explode(F.array(*found)).alias("f")).select("f.finding", "dataset", "f.detail", "f.observed_count"))
    return parts[0].unionByName(parts[1]).where("observed_count > 0")


def identity_differences(star: Star, uptime: DataFrame, failures: DataFrame) -> DataFrame:
    """finding, dataset, observed_count: identities that only the source has (missing) or only the fact (unexpected), in one outer pass each."""
    daily, event = ("event_date", "machine_id", *PLACE), ("event_id", "event_date", "machine_id", *PLACE, "fault_code", "severity")
    parts = []
    for fact, source, names in (("fact_machine_uptime_daily", uptime, daily), ("fact_machine_failure_event", failures, event)):
        have = natural(star, fact).select(*names, F.lit(1).alias("_f"), F.lit(0).alias("_s"))
        want = source.select(*names, F.lit(0).alias("_f"), F.lit(1).alias("_s"))
        sides = have.unionByName(want).groupBy(*names).agg(F.max("_f").alias("f"), F.max("_s").alias("s"))
        one = sides.agg(F.count_if(F.expr("f < s")).alias("missing_fact_identity"), F.count_if(F.expr("f > s")).alias("unexpected_fact_identity"))
        parts.append(one.unpivot([], ["missing_fact_identity", "unexpected_fact_identity"], "finding", "observed_count").withColumn("dataset", F.lit(fact)))
    return parts[0].unionByName(parts[1])


def measure_differences(star: Star, uptime: DataFrame, failures: DataFrame) -> DataFrame:
    """dataset, measure, observed_count: facts whose measure differs from the source's, NULL equal to NULL, all measures in one pass. A row that only one side has differs in all."""
    sets = (
        ("fact_machine_uptime_daily", uptime, ("event_date", "machine_id", *PLACE), (*[c for c in uptime.columns if c.endswith("_minutes")], "uptime_pct", "avg_health_score", "downtime_load_pct")),
        ("fact_machine_failure_event", failures, ("event_id",), ("temperature_c", "vibration_mm_s", "downtime_minutes", "maintenance_cost_gbp", "part_code", "part_quantity")),
    )
    parts = []
    for fact, source, names, measures in sets:
        have = natural(star, fact).select(*names, F.struct(*measures).alias("_f"))
        want = source.select(*[F.col(c).alias(f"_{c}") for c in names], F.struct(*measures).alias("_s"))
        on = F.lit(True)
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        both = have.join(want, on, "full")
        alone = F.col("_f").isNull() | F.col("_s").isNull()
        one = both.agg(*[F.count_if(alone | ~F.col(f"_f.{m}").eqNullSafe(F.col(f"_s.{m}"))).alias(m) for m in measures])
        parts.append(one.unpivot([], list(measures), "measure", "observed_count").withColumn("dataset", F.lit(fact)))
    return parts[0].unionByName(parts[1])


def assignment_findings(uptime: DataFrame, failures: DataFrame) -> DataFrame:
    """finding, dataset, observed_count of what the policy on assignments blocks: machine-days with several sets of attributes, and machine-days that lack one. No unknown member stands in for it."""
    days = unsettled_days(observations(uptime, failures))
    one = days.agg(F.count_if(F.col("attribute_sets") > 1).alias("same_day_assignment_conflict"), F.count_if("lacks_attribute").alias("missing_assignment_identity"))
    found = one.unpivot([], one.columns, "finding", "observed_count").where("observed_count > 0")
    return found.select("finding", F.lit("machine_assignment").alias("dataset"), "observed_count")


def require_settled(uptime: DataFrame, failures: DataFrame) -> None:
    """Raises where the marts can't make a star under the policy on assignments: no uptime rows, or machine-days that aren't settled."""
    if uptime.isEmpty():
        raise ValueError("the uptime mart has no rows")
    if found := {r.finding: r.observed_count for r in assignment_findings(uptime, failures).collect()}:
        raise ValueError(f"assignments aren't settled: {found}")


def publication_findings(star: Star, uptime: DataFrame, failures: DataFrame) -> DataFrame:
    """finding, dataset, detail, observed_count of all audits that stand before a publication: counts, grains and keys, identities, and measures. Counts of 0 aren't listed."""
    identities = identity_differences(star, uptime, failures).withColumn("detail", F.lit(""))
    measures = measure_differences(star, uptime, failures).withColumn("finding", F.lit("fact_measure_mismatch")).withColumnRenamed("measure", "detail")
    names = ("finding", "dataset", "detail", "observed_count")
    out = audit(star, uptime, failures).select(*names)
    for part in (identities, measures):
        out = out.unionByName(part.select(*names))
    return out.where("observed_count > 0")


#: The order of a contract's findings.
CONTRACT_ORDER = (
    "machine_assignment_conflict", "missing_grain_key", "null_grain_key", "duplicate_uptime_grain", "duplicate_failure_grain",
    "missing_dimension_key", "null_dimension_key", "unmatched_dimension_key", "source_fact_count_mismatch",
)


def row_contract(star: Star, uptime: DataFrame, failures: DataFrame) -> DataFrame:
    """code, dataset, keys, detail: each violation of the star's row contract with the row or grain that it is about.

    keys is text, `name=value` by name, with values as they are. A column that a fact lacks is one finding without keys.
    Members are missing where a dimension has none. Rows come unsorted; CONTRACT_ORDER has the order of codes.
    """

    def keys(*names: str) -> Column:
        return F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in sorted(names)])

    def finding(df: DataFrame, code: str, dataset: str, where: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(dataset).alias("dataset"), where.alias("keys"), detail.cast("string").alias("detail"))

    conflicts = unsettled_days(observations(uptime, failures)).where("attribute_sets > 1")
    parts = [finding(conflicts, "machine_assignment_conflict", "machine_assignment", keys("event_date", "machine_id"), F.col("attribute_sets"))]
    for fact, source, grain, repeated in (
        ("fact_machine_uptime_daily", uptime, ("date_key", "machine_key"), "duplicate_uptime_grain"),
        ("fact_machine_failure_event", failures, ("event_id",), "duplicate_failure_grain"),
    ):
        rows = getattr(star, fact)
        wanted = [k for k in FOREIGN if k != "fault_key" or fact == "fact_machine_failure_event"]
        nothing = rows.sparkSession.range(1)
        there = [g for g in grain if g in rows.columns]
        parts += [finding(nothing, "missing_grain_key", fact, F.lit(""), F.lit(g)) for g in grain if g not in rows.columns]
        parts += [finding(nothing, "missing_dimension_key", fact, F.lit(""), F.lit(k)) for k in wanted if k not in rows.columns]
        parts += [finding(rows.where(F.col(g).isNull()), "null_grain_key", fact, keys(*there), F.lit(g)) for g in there]
        if len(there) == len(grain):
            parts.append(finding(rows.groupBy(*grain).count().where("count > 1"), repeated, fact, keys(*grain), F.col("count")))
        for k in (k for k in wanted if k in rows.columns):
            parts.append(finding(rows.where(F.col(k).isNull()), "null_dimension_key", fact, keys(*there), F.lit(k)))
            members = getattr(star, FOREIGN[k][0]).select(F.col(k).alias("_k"))
            lost = rows.where(F.col(k).isNotNull()).join(members, F.col(k) == F.col("_k"), "left_anti")
            parts.append(finding(lost, "unmatched_dimension_key", fact, keys(*there), F.lit(k)))
        counts = rows.agg(F.count("*").alias("have")).crossJoin(F.broadcast(source.agg(F.count("*").alias("want")))).where("have <> want")  # one row each
        parts.append(finding(counts, "source_fact_count_mismatch", fact, F.lit(""), F.concat_ws("<>", "want", "have")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
