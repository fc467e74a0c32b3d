"""Continuous periods out of overlapping intervals, and the holes between them.

Sessions with a gap per row merge what overlaps. Entities with very many rows are cut into pieces of time by density, see
shards: each piece is merged by itself, given how far the pieces before it reach, and only its first and last period meet
those of other pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.functions.staging import stage
from quarrylake.operators.shards import Cuts, cuts_of, with_piece

#: Rows of a piece of a large entity's time.
PIECE = 50_000
#: Seconds that a session's gap has at most: instants have an end. What lasts longer is carried on as a number.
HORIZON = 100 * 366 * 86_400


def continuous_periods(intervals: DataFrame, keys: list[str], start: str, length: str, cuts: Cuts | None = None) -> DataFrame:
    """keys, start_s, end_s, next_start_s: the union of [start, start + length) by keys, as disjoint periods.

    start and length are whole seconds. Intervals that overlap or touch become one period; next_start_s is the start of
    the same keys' next period, NULL for the last. Rows whose start or length is NULL, and lengths of 0 or less, have no
    part. NULL is a key value as any other. Repeated rows change nothing. An empty table gives an empty table. Without
    cuts (of one of the keys) every key stays whole; no result depends on them.
    """
    some = intervals.select(*dict.fromkeys([*keys, start, length])).where(F.col(start).isNotNull() & (F.col(length) > 0))
    rows = with_piece(some, cuts, start, PIECE).select(
        *keys,
        "_piece",
        F.timestamp_seconds(F.col(start)).alias("_at"),
        F.make_interval(secs=F.least(F.col(length), F.lit(HORIZON)).cast("decimal(18,6)")).alias("_gap"),
        (F.col(start) + F.col(length)).alias("_until"),
    )
    place = [*keys, "_piece"]
    sessions = rows.groupBy(*place, F.session_window("_at", F.col("_gap")).alias("_session")).agg(F.max("_until").alias("end_s"))
    sessions = sessions.select(*place, F.unix_seconds("_session.start").alias("start_s"), "end_s")
    periods = _stitched(sessions, place)
    if cuts is None:
        return _with_next(periods, place).select(*keys, "start_s", "end_s", "next_start_s")
    periods = stage(periods)
    whole = _with_next(periods.where("_piece < 0"), place).select(*keys, "start_s", "end_s", "next_start_s")
    return whole.unionByName(_across(periods.where("_piece >= 0"), keys))


def _stitched(sessions: DataFrame, place: list[str], before: str | None = None) -> DataFrame:
    """place, start_s, end_s and _island of periods out of what overlaps or touches within each place; island 0 is what is reached from before."""
    w = W.partitionBy(*place).orderBy("start_s")
    so_far = F.max("end_s").over(w.rowsBetween(W.unboundedPreceding, -1))
    so_far = F.greatest(so_far, F.col(before)) if before else so_far
    fresh = sessions.withColumn("_new", F.when(F.col("start_s") <= so_far, 0).otherwise(1))
    islands = fresh.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*place, "_island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def _with_next(periods: DataFrame, place: list[str]) -> DataFrame:
    return periods.withColumn("next_start_s", F.lead("start_s").over(W.partitionBy(*place).orderBy("start_s")))


def _across(periods: DataFrame, keys: list[str]) -> DataFrame:
    """The periods of entities that are cut, joined across their pieces. No window holds more than a piece's periods or a few rows per piece."""
    place = [*keys, "_piece"]
    reach = periods.groupBy(*place).agg(F.max("end_s").alias("_r"))
    before = F.max("_r").over(W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    reach = reach.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(place)], before.alias("_before"))
    same = F.lit(True)
    for i, k in enumerate(place):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    periods = _with_next(_stitched(periods.drop("_island").join(reach, same), place, "_before"), place)

    # island 0 goes on with one of an earlier piece; a piece's last period may go on, and its next begins in a later piece
    out = [*keys, "start_s", "end_s", "next_start_s"]
    last = F.col("next_start_s").isNull()
    inner = periods.where((F.col("_island") > 0) & ~last).select(*out)
    opens = F.col("_island") > 0
    marks = periods.where((F.col("_island") <= 1) | last)
    in_time = W.partitionBy(*keys).orderBy("_piece", "_island").rowsBetween(W.unboundedPreceding, 0)
    marks = marks.withColumn("_g", F.sum(F.when(opens, 1).otherwise(0)).over(in_time))
    joined = marks.groupBy(*keys, "_g").agg(F.min(F.when(opens, F.col("start_s"))).alias("start_s"), F.max("end_s").alias("end_s"), F.max(opens & last).alias("_last"))
    return inner.unionByName(_with_next(joined, keys).where("_last").select(*out))


def seconds_of(minutes: Column) -> Column:
    """Whole seconds of minutes, rounded; beyond what a bigint of seconds holds, about as many as it holds."""
    return F.greatest(F.least(F.round(minutes.cast("double") * 60), F.lit(9.0e18)), F.lit(-9.0e18)).cast("bigint")


def periods_and_gaps(events: DataFrame, max_gap_s: int = 7 * 86_400, times: DataFrame | None = None) -> DataFrame:
    """kind, machine_id, start_s, end_s out of trusted events: `report` and `down` periods, and `gap` rows.

    A gap is the hole between two neighbouring reporting periods of one machine, of max_gap_s at most. times
    (machine_id, epoch_s) holds at least the events' times, where they can be read more cheaply than from events.
    """
    both = F.array(
        F.struct(F.lit("report").alias("kind"), seconds_of(F.col("duration_minutes")).alias("len_s")),
        F.struct(F.lit("down").alias("kind"), seconds_of(F.col("downtime_minutes")).alias("len_s")),
    )
    rows = events.select("machine_id", "epoch_s", F.explode(both).alias("_i")).select("machine_id", "epoch_s", "_i.*")
    cuts = cuts_of(events if times is None else times, "machine_id", "epoch_s")
    periods = continuous_periods(rows, ["kind", "machine_id"], "epoch_s", "len_s", cuts)
    gap = (F.col("kind") == "report") & (F.col("next_start_s") - F.col("end_s") <= max_gap_s)
    out = F.array_compact(
        F.array(
            F.struct("kind", "start_s", "end_s"),
            F.when(gap, F.struct(F.lit("gap").alias("kind"), F.col("end_s").alias("start_s"), F.col("next_start_s").alias("end_s"))),
        )
    )
    return periods.select("machine_id", F.explode(out).alias("_p")).select("_p.kind", "machine_id", "_p.start_s", "_p.end_s")
