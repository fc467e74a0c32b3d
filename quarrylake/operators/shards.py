"""Cutting the time of entities with very many rows, where their rows lie dense.

How many rows each entity has is read first, and quantiles of their times for those that have many. The others stay
whole; these are cut at the quantiles, and very large ones evenly within, so that a piece has about the rows asked for
however they lie in time. What is read for it is a row per large entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an entity from which it is cut, and quantiles of its time.
HOT, QUANTILES = 50_000, 256
#: Entities that are cut are named in the plan up to this many, which bounds what is broadcast; beyond it they are joined.
NAMED = 10_000


@dataclass(frozen=True)
class Cuts:
    """The entities that are cut, with their number of rows _n and their cut times _cuts."""

    entity: str
    table: DataFrame
    named: bool

    def small(self, df: DataFrame) -> DataFrame:
        """df, a row per entity that is cut, broadcast where there are few."""
        return F.broadcast(df) if self.named else df


def cuts_of(times: DataFrame, entity: str, at: str) -> Cuts | None:
    """The cuts of entities with more than HOT rows in times (entity, at: whole seconds); None where there are none.

    Rows are counted first, from the entity alone; only what is large has its times read.
    """
    large = times.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT)
    first = large.limit(NAMED + 1).collect()
    if not first:
        return None
    named = len(first) <= NAMED
    # a filter goes below what computes the times, a join doesn't
    rows = times.where(F.col(entity).isin([r[0] for r in first])) if named else times.join(large.select(entity), entity)
    quantile = F.array_distinct(F.percentile_approx(F.col(at).cast("bigint"), [i / QUANTILES for i in range(QUANTILES + 1)], 2_000))
    cut = rows.where(F.col(at).isNotNull()).groupBy(entity).agg(quantile.alias("_cuts"))
    if not named:
        return Cuts(entity, cut.join(large, entity), False)
    counts, kind = dict(map(tuple, first)), dict(times.dtypes)[entity]
    found = [(r[0], counts[r[0]], r[1]) for r in cut.collect()]
    return Cuts(entity, times.sparkSession.createDataFrame(found, f"{entity} {kind}, _n bigint, _cuts array<bigint>"), True) if found else None


def _slices(piece_rows: int):
    return F.ceil(F.col("_n") / (QUANTILES * piece_rows))


def with_piece(rows: DataFrame, cuts: Cuts | None, at: str, piece_rows: int) -> DataFrame:
    """rows with _piece: the number of its entity's piece of time, in order of time; -1 for entities that stay whole and NULL times."""
    if cuts is None:
        return rows.withColumn("_piece", F.lit(-1).cast("bigint"))
    columns = [F.col(c) for c in rows.columns]
    joined = rows.join(cuts.small(cuts.table), cuts.entity, "left")
    joined = joined.withColumn("_b", F.greatest(F.size(F.filter("_cuts", lambda c: c <= F.col(at))) - 1, F.lit(0)))
    lo, hi, slices = F.get("_cuts", F.col("_b")), F.get("_cuts", F.col("_b") + 1), _slices(piece_rows)
    within = F.least(F.greatest(F.floor((F.col(at) - lo) / (hi - lo) * slices), F.lit(0)), slices - 1)
    piece = F.when(F.col("_cuts").isNull() | F.col(at).isNull(), F.lit(-1)).otherwise(F.col("_b") * slices + F.coalesce(within, F.lit(0)))
    return joined.select(*columns, piece.cast("bigint").alias("_piece"))


def pieces(cuts: Cuts, piece_rows: int) -> DataFrame:
    """entity and _piece: every piece of the entities that are cut."""
    last = F.size("_cuts") * _slices(piece_rows) - 1
    return cuts.table.select(cuts.entity, F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("_piece"))
