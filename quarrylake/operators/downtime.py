"""Whether a table keeps to the rule that relates downtime to observation: audits in one aggregation, and a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators import marts, star

MINUTES = (*marts.STATUS_MINUTES.values(), "observed_minutes", "downtime_minutes")
#: The columns that state the rule's results, and how far percentages may be off.
STATED = ("downtime_load_pct", "downtime_pct", "downtime_exceeds_observed", "downtime_semantics_version")
TOLERANCE = 0.01


def _off(a: Column, b: Column) -> Column:
    """Whether two percentages differ by more than the tolerance; missing equals missing."""
    a, b = a.cast("double"), b.cast("double")
    return ~a.eqNullSafe(b) & ~F.coalesce(F.abs(a - b) <= TOLERANCE, F.lit(False))


def _counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """finding and observed_count of the rows that break each rule, in one aggregation; rules that no row breaks aren't listed."""
    one = df.agg(*[F.count_if(F.coalesce(when, F.lit(False))).alias(code) for code, when in rules.items()])
    return one.unpivot([], list(rules), "finding", "observed_count").where("observed_count > 0")


def _lacking(df: DataFrame, needed: tuple[str, ...], code: str) -> DataFrame | None:
    lacking = len(set(needed) - set(df.columns))
    return df.sparkSession.createDataFrame([(code, lacking)], "finding string, observed_count bigint") if lacking else None


def _rules(df: DataFrame) -> dict[str, Column]:
    missing, negative = F.lit(False), F.lit(False)
    for c in MINUTES:
        missing, negative = missing | F.col(c).isNull(), negative | F.coalesce(F.col(c) < 0, F.lit(False))
    in_status = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in marts.STATUS_MINUTES.values()), F.lit(0.0))
    rules = {
        "required_semantic_value_missing": missing,
        "negative_duration_value": negative,
        "status_minutes_exceed_observed": in_status > F.coalesce(F.col("observed_minutes").cast("double"), F.lit(0.0)),
    }
    if "downtime_pct" in df.columns:
        rules["legacy_downtime_pct_formula_mismatch"] = _off(F.col("downtime_pct"), marts.downtime_load())
    return rules


def semantic_findings(df: DataFrame) -> DataFrame:
    """finding, observed_count of rows with missing or negative minutes, with more minutes in states than observed, or with a downtime_pct that isn't the load.

    Downtime beyond observation, and a load beyond 100, are valid. A table that lacks a column of minutes has the only
    finding missing_semantic_columns, with the number of columns.
    """
    return (r if (r := _lacking(df, MINUTES, "missing_semantic_columns")) is not None else _counted(df, _rules(df)))


def materialised_findings(df: DataFrame) -> DataFrame:
    """semantic_findings, and rows whose stated load, alias, flag or version isn't what the rule gives. A table that lacks a column has only that finding."""
    if (lacking := _lacking(df, (*MINUTES, *STATED), "missing_materialized_downtime_columns")) is not None:
        return lacking
    down, seen = F.col("downtime_minutes"), F.col("observed_minutes")
    return _counted(
        df,
        _rules(df)
        | {
            "downtime_load_formula_mismatch": _off(F.col("downtime_load_pct"), marts.downtime_load()),
            "downtime_compatibility_alias_mismatch": _off(F.col("downtime_pct"), F.col("downtime_load_pct")),
            "downtime_exceedance_flag_mismatch": ~F.col("downtime_exceeds_observed").cast("boolean").eqNullSafe(down > seen),
            "downtime_semantics_version_mismatch": ~F.col("downtime_semantics_version").eqNullSafe(F.lit(marts.SEMANTICS)),
        },
    )


def raise_findings(findings: DataFrame, label: str) -> None:
    """Raises if there are findings, a row per code at most."""
    if found := sorted((r.finding, r.observed_count) for r in findings.select("finding", "observed_count").collect()):
        raise ValueError(f"{label}: " + ", ".join(f"{code} {n}" for code, n in found))


def materialise_or_validate(df: DataFrame, label: str) -> DataFrame:
    """df with the rule's results: added where it states none of them, checked where it states all. Part of them, and findings, raise."""
    stated = [c for c in STATED if c in df.columns]
    if stated and len(stated) < len(STATED):
        raise ValueError(f"{label} states only {', '.join(stated)}")
    out = df if stated else marts.with_downtime_semantics(df)
    raise_findings(materialised_findings(out), label)
    return out


def governed_marts(silver: DataFrame) -> dict[str, DataFrame]:
    """The marts of trusted events, the uptime mart held to the rule."""
    days = materialise_or_validate(marts.machine_days(silver), "machine_uptime")
    return {
        "machine_uptime": days.drop(*marts.OF_FAILURES),
        "failure_events": marts.failure_events(silver),
        "maintenance_costs": marts.maintenance_costs(silver),
        "parts_usage": marts.parts_usage(silver),
        "client_asset_summary": marts.asset_summary(days),
    }


def governed_star(uptime: DataFrame, failures: DataFrame) -> star.Star:
    """The star of marts that keep to the rule, and whose uptime fact does."""
    s = star.build_star(materialise_or_validate(uptime, "machine_uptime"), failures)
    raise_findings(materialised_findings(s.fact_machine_uptime_daily), "fact_machine_uptime_daily")
    return s


def star_findings(s: star.Star, uptime: DataFrame) -> DataFrame:
    """finding, dataset, observed_count of the mart and the fact against the rule."""
    parts = [materialised_findings(df).withColumn("dataset", F.lit(n)) for n, df in (("machine_uptime", uptime), ("fact_machine_uptime_daily", s.fact_machine_uptime_daily))]
    return parts[0].unionByName(parts[1]).select("finding", "dataset", "observed_count")
