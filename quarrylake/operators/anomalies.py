"""Readings that a machine can't really have had.

Each machine's readings of a field follow a hidden Markov model of four states. Out of range emits what no machine can
read, and hard bounds tell it from the others. Normal advances from the last normal reading, however many spikes lie
between, by the machine's usual step and scatter, or rarely by a lasting change of level. A spike emits what is far from
the normal readings around it and tells nothing about them; it is followed by another spike at a fixed price. Stuck emits
one number over and over: its segments are whole runs of at least STUCK equal readings, entered at a price that a run of
equal normal readings exceeds. Forward-backward probabilities weigh the states.

What is usual for a machine is estimated once for all of its readings. Machines with many rows are cut into shards of
time with a halo of rows on both sides, and what is usual for them is a distributed count of their steps, so that a
reading's state depends neither on the cuts nor on how rows lie in partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.functions.shipping import shipped
from quarrylake.operators.shards import cuts_of, with_piece


@dataclass(frozen=True)
class Reading:
    """lo and hi: possible values. least: scatter below which no machine is taken to be. drifts: whether readings advance by a usual step.

    rise and fall: minus the logarithm of the odds of a lasting change of level up and down, more: of one more spike after
    three. edge: what makes a spike less likely at a series' begin or end, where its return can't be seen.
    """

    lo: float
    hi: float
    least: float
    drifts: bool = False
    rise: float = 14.0
    fall: float = 14.0
    edge: float = 0.0
    more: float = 1.0


READINGS = {
    "temperature_c": Reading(-90.0, 400.0, 0.5),
    "vibration_mm_s": Reading(0.0, 1000.0, 0.05),
    "fuel_level_pct": Reading(0.0, 100.0, 0.8, True, 8.5, 12.0, 6.0, 3.5),
    "hour_meter": Reading(0.0, np.inf, 1.0, True),
}
#: Successive equal readings that make a stuck run, and the longest run of spikes: what stays away longer is a level of its own.
STUCK, TOGETHER = 6, 8
#: Minus the logarithm of the odds of a first spike and of a second or third; the tail of normal steps and the least
#: distance of a spike from the normal readings around it, in units of the scatter.
SPIKE, AGAIN, TAIL, FAR = 6.2, 1.0, 2.0, 5.0
#: Of becoming stuck, and of a normal reading that repeats the number of a stuck run.
STICK, REPEAT = 10.0, 10.0
#: Of a change of level after a stuck run, and of a spike right after one.
RELEASE, FREED = 2.0, 5.0
#: Rows of one piece of a large machine's time, and pieces of a shard.
PIECE, SHARD = 6_250, 8
#: Rows that are judged at a time, rows of context at a cut, and readings in one column of the recursion.
ROWS, CONTEXT, COLUMN = 100_000, 64, 512


def _grouped_median(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of each group's values (the lower one of two), 0 where it has none; NaN is no value."""
    some = ~np.isnan(values)
    v, g = values[some], group[some]
    order = np.lexsort((v, g))
    count = np.bincount(g, minlength=groups)
    start = np.cumsum(count) - count
    out = np.zeros(groups)
    has = count > 0
    out[has] = v[order][(start + (count - 1) // 2)[has]]
    return out


def _steps(x: np.ndarray, group: np.ndarray, stuck: np.ndarray) -> np.ndarray:
    """Each reading's step from the one before, to four digits; NaN for a group's first and within stuck runs."""
    step = np.full(len(x), np.nan)
    d = np.diff(x)
    with np.errstate(divide="ignore"):
        unit = 10.0 ** np.maximum(np.floor(np.log10(np.abs(d))) - 3, -6)
    step[1:] = np.where((group[1:] == group[:-1]) & ~(stuck[1:] & stuck[:-1]), np.round(d / unit) * unit + 0.0, np.nan)
    return step


def _usual(x: np.ndarray, group: np.ndarray, groups: int, stuck: np.ndarray, kind: Reading) -> tuple[np.ndarray, np.ndarray]:
    """(usual step, median distance of steps from it) of each group."""
    step = _steps(x, group, stuck)
    usual = _grouped_median(step, group, groups) if kind.drifts else np.zeros(groups)
    return usual, _grouped_median(np.abs(step - usual[group]), group, groups)


def _log_sum(parts: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials along the first axis."""
    top = parts.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(parts - safe).sum(0))


def probabilities(x: np.ndarray, group: np.ndarray, stuck: np.ndarray, kind: Reading, usual: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of a spike, of being stuck) for each reading. Readings come by group, in order of time; groups are 0, 1, ... without a hole.

    stuck marks readings in runs of at least STUCK equal ones; usual and scatter are each group's.
    """
    n, reach = len(x), TOGETHER + 1  # a step reaches back over TOGETHER spikes at most
    if n == 0:
        return np.zeros(0), np.zeros(0)
    scatter = 1.4826 * scatter
    scale = np.maximum(np.maximum(scatter, 2 * np.abs(usual)) if not np.isfinite(kind.hi) else scatter, kind.least)[group]
    wide = np.maximum(scale, 0.7 * np.abs(usual[group]))  # a step goes further at times
    usual = usual[group]
    same = np.r_[False, (x[1:] == x[:-1]) & (group[1:] == group[:-1])] & stuck  # goes on with a stuck run

    def far(k: int) -> np.ndarray:
        """Whether reading j is far from reading j + k, which is of the same group."""
        out = np.zeros(n, bool)
        if k < n:
            out[:-k] = (group[k:] == group[:-k]) & (np.abs(x[k:] - x[:-k] - k * usual[k:]) > FAR * scale[k:])
        return out

    odds = lambda k: -(SPIKE + min(k - 1, 2) * AGAIN + max(k - 3, 0) * kind.more) if k else 0.0
    # spikes[k]: the k readings before j are far from it; ahead_of[k]: the k readings after j are
    spikes, ahead_of = [np.ones(n, bool)], [np.ones(n, bool)]
    for k in range(1, reach):
        after, before = far(k), np.zeros(n, bool)
        before[k:] = after[: n - k] if k < n else False
        spikes.append(spikes[-1] & before)
        ahead_of.append(ahead_of[-1] & after)

    # log of the weight of stepping from reading j - k to j with k - 1 spikes between; a spike is no likely part of a stuck run
    repeats = np.cumsum(same)
    jump = np.full((reach, n), -np.inf)
    for k in range(1, min(reach, n - 1) + 1):
        to, at = x[k:], x[:-k]
        moved = to - at - k * usual[k:]
        u = np.abs(moved) / np.where(moved * usual[k:] > 0, wide[k:], scale[k:])
        level = np.where(moved > 0, kind.rise, kind.fall)
        level = np.where(stuck[:-k] & ~same[k:], np.minimum(level, RELEASE), level)
        between = REPEAT * (repeats[k - 1 : -1] - repeats[:-k]) if k > 1 else 0.0
        weight = np.logaddexp(-u / TAIL, -level) + odds(k - 1) - between - np.where(stuck[:-k] & (k > 1), FREED, 0.0)
        jump[k - 1, k:] = np.where((group[k:] == group[:-k]) & spikes[k - 1][k:] & ahead_of[k - 1][:-k], weight, -np.inf)

    # columns of at most COLUMN readings, that overlap; a column begins and ends as if the series did
    first = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    size = np.diff(np.r_[first, n])
    pieces = [(a, s, o, min(COLUMN, s - o)) for a, s in zip(first, size) for o in range(0, max(1, s - CONTEXT), COLUMN - CONTEXT)]
    pieces.sort(key=lambda p: -p[3])
    spike, run = np.zeros(n), np.zeros(n)
    half = CONTEXT // 2
    while pieces:  # columns of about one length together
        some = [p for p in pieces if 2 * p[3] > pieces[0][3]]
        pieces = pieces[len(some) :]
        start, length = np.array([a + o for a, s, o, m in some]), np.array([m for *_, m in some])
        top, width = int(length[0]), len(start)
        live = [int(np.searchsorted(-length, -t, "left")) for t in range(top)]  # columns longer than t
        last = np.arange(width), length - 1
        at = np.where(np.arange(top)[:, None] < length, start + np.arange(top)[:, None], 0)
        goes, held_at = same[at], stuck[at]
        goes[0] = False
        leaves = held_at & ~np.concatenate([goes[1:], np.zeros((1, width), bool)])
        leaves[last[1], last[0]] = held_at[last[1], last[0]]
        enters, again = held_at & ~goes, np.where(goes, REPEAT, 0.0)
        weights = np.concatenate([jump[:, at].transpose(1, 0, 2), np.full((reach, reach, width), -np.inf)])  # by time, k, column
        # spikes before a column's first normal reading, and after its last
        lead, trail = np.full((reach, width), -np.inf), np.full((reach, width), -np.inf)
        for k in range(reach):
            has = np.flatnonzero(length > k)
            a, z = start[has] + k, start[has] + length[has] - 1 - k
            cost = odds(k) - kind.edge * (k > 0)
            lead[k, has] = np.where(spikes[k][a], cost - (REPEAT * (repeats[a - 1] - repeats[start[has]]) if k > 1 else 0.0), -np.inf)
            trail[k, has] = np.where(ahead_of[k][z], cost - (REPEAT * (repeats[z + k] - repeats[z + 1]) if k > 1 else 0.0), -np.inf)

        # out[t + reach]: of all that ends with reading t as the last normal or stuck one
        out, normal, held = np.full((top + reach, width), -np.inf), np.full((top, width), -np.inf), np.full((top, width), -np.inf)
        for t in range(top):
            m = live[t]
            base = _log_sum(out[t : t + reach, :m][::-1] + weights[t, :, :m])
            if t < reach:
                base = np.logaddexp(base, lead[t, :m])
            normal[t, :m] = base - again[t, :m]
            held[t, :m] = np.where(enters[t, :m], base - STICK, np.where(goes[t, :m], held[t - 1, :m], -np.inf))
            out[t + reach, :m] = np.logaddexp(normal[t, :m], np.where(leaves[t, :m], held[t, :m], -np.inf))
        # into[t]: of all that follows from stepping to reading t, with what t itself weighs
        into, after, hold = np.full((top + reach, width), -np.inf), np.full((top, width), -np.inf), np.full((top + 1, width), -np.inf)
        steps = np.arange(reach)
        for t in range(top - 1, -1, -1):
            m = live[t]
            base = _log_sum(into[t + 1 : t + 1 + reach, :m] + weights[t + 1 + steps, steps, :m])
            left = length[:m] - 1 - t
            near = left < reach
            if near.any():
                base = np.where(near, np.logaddexp(base, trail[np.minimum(left, reach - 1), np.arange(m)]), base)
            after[t, :m] = base
            hold[t, :m] = np.where(leaves[t, :m], base, np.where(held_at[t, :m], hold[t + 1, :m], -np.inf))
            into[t, :m] = np.logaddexp(base - again[t, :m], np.where(enters[t, :m], hold[t, :m] - STICK, -np.inf))
        total = _log_sum(lead + into[:reach])

        for c, (a, s, o, m) in enumerate(some):
            lo, hi = (0 if o == 0 else half), (m if o + m >= s else m - half)
            is_normal = np.exp(np.minimum(normal[lo:hi, c] + after[lo:hi, c] - total[c], 0.0))
            is_stuck = np.exp(np.minimum(held[lo:hi, c] + hold[lo:hi, c] - total[c], 0.0))
            spike[a + o + lo : a + o + hi] = np.maximum(1.0 - is_normal - is_stuck, 0.0)
            run[a + o + lo : a + o + hi] = is_stuck
    return spike, run


def _possible(x: np.ndarray, group: np.ndarray, kind: Reading) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where there is a reading, which of these a machine can read, which are in a stuck run)."""
    at = np.flatnonzero(~np.isnan(x))
    v, g = x[at], group[at]
    run = np.cumsum(np.r_[True, (np.diff(v) != 0) | (np.diff(g) != 0)][: len(v)]) - 1
    return at, (v >= kind.lo) & (v <= kind.hi), np.bincount(run)[run] >= STUCK if len(v) else np.zeros(0, bool)


def judge(x: np.ndarray, group: np.ndarray, kind: Reading, usual: np.ndarray | None = None, scatter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(state 0 normal, 1 spike, 2 stuck, 3 out of range; probability of the state) of readings by group in order of time; NaN is no reading.

    usual and scatter, a value per row, are what is known of the row's group; NaN where it is to be estimated from its rows.
    """
    state, probability = np.zeros(len(x), np.int8), np.zeros(len(x))
    at, possible, stuck = _possible(x, group, kind)
    state[at[~possible]], probability[at] = 3, 1.0
    at, stuck = at[possible], stuck[possible]
    if not len(at):
        return state, probability
    g, rows = np.unique(group[at], return_index=True)[1], np.unique(group[at], return_inverse=True)[1]
    own = _usual(x[at], rows, len(g), stuck, kind)
    known = [np.where(np.isnan(k[at[g]]), o, k[at[g]]) if k is not None else o for k, o in zip((usual, scatter), own)]
    spike, run = probabilities(x[at], rows, stuck, kind, *known)
    s = np.where(spike > 0.5, 1, np.where(run > 0.5, 2, 0))
    state[at], probability[at] = s, np.where(s == 0, 1 - spike - run, np.where(s == 1, spike, run))
    return state, probability


NAMES = np.array(["normal", "spike", "stuck", "out_of_range"])
OUT = "event_id string, machine_id string, epoch_s bigint, reading_field string, reading double, state string, probability double"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, group of each, whether it is judged here): whole machines or shards, but that a shard beyond ROWS is cut with rows of context."""

    def block(table: pa.Table, lo: int, hi: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = table.combine_chunks()
        here = table.column("_own").to_numpy(zero_copy_only=False).copy()
        here[:lo] = here[hi:] = False
        return table, np.cumsum(np.r_[True, changes(table)]) - 1, here

    def changes(table: pa.Table) -> np.ndarray:
        machine = table.column("machine_id").combine_chunks().dictionary_encode().indices.to_numpy()
        return (np.diff(machine) != 0) | (np.diff(table.column("_shard").to_numpy()) != 0)

    held, rows, skip = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held)
        ends = np.flatnonzero(changes(table))
        if len(ends):  # whole groups; the last one goes on
            last = int(ends[-1]) + 1
            yield block(table, skip, last)
            table, skip = table.slice(last), 0
        if table.num_rows >= ROWS:
            yield block(table, skip, table.num_rows - CONTEXT)
            table, skip = table.slice(table.num_rows - 2 * CONTEXT), CONTEXT
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield block(pa.Table.from_batches(held), skip, rows)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False).astype(float)


def _flag(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group, here in _blocks(batches):
            cut = table.column("_shard").to_numpy() >= 0
            known = {c: np.where(cut, np.nan_to_num(_column(table, c)), np.nan) for c in table.column_names if c.startswith(("_usual_", "_scatter_"))}
            for f in fields:
                x = _column(table, f)
                state, p = judge(x, group, READINGS[f], known.get(f"_usual_{f}"), known.get(f"_scatter_{f}"))
                hit = np.flatnonzero((state > 0) & here)
                if len(hit):
                    rows = table.select(["event_id", "machine_id", "epoch_s"]).take(pa.array(hit)).combine_chunks()
                    columns = [c.combine_chunks() for c in rows.columns]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array([f] * len(hit)), pa.array(x[hit]), pa.array(NAMES[state[hit]].tolist()), pa.array(p[hit])],
                        names=["event_id", "machine_id", "epoch_s", "reading_field", "reading", "state", "probability"],
                    )

    return run


def _count_steps(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group, here in _blocks(batches):
            first = np.flatnonzero(np.r_[True, np.diff(group) != 0])
            machine = table.column("machine_id").take(pa.array(first)).combine_chunks()
            for f in fields:
                x = _column(table, f)
                at, possible, stuck = _possible(x, group, READINGS[f])
                at, stuck = at[possible], stuck[possible]
                if len(at):
                    step = _steps(x[at], group[at], stuck)
                    some = ~np.isnan(step) & here[at]
                    pairs, n = np.unique(np.stack([group[at][some].astype(float), step[some]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [machine.take(pa.array(pairs[0].astype(np.int64))), pa.array([f] * len(n), pa.string()), pa.array(pairs[1]), pa.array(n.astype(np.int64))], names=["machine_id", "field", "step", "n"]
                    )

    return run


def _habits(shards: DataFrame, fields: list[str]) -> DataFrame:
    """machine_id, and _usual_ and _scatter_ of each field: medians of all steps of a machine that is cut, from counts of equal steps."""
    counted = shipped(shards).sortWithinPartitions("machine_id", "_shard", "epoch_s", "event_id").mapInArrow(_count_steps(fields), "machine_id string, field string, step double, n bigint")
    counts = counted.groupBy("machine_id", "field", "step").agg(F.sum("n").alias("n"))
    one = W.partitionBy("machine_id", "field")

    def median(c: str):
        upto = F.sum("n").over(one.orderBy(c).rangeBetween(W.unboundedPreceding, 0))
        return F.when(upto > F.expr("(_all - 1) div 2"), F.col(c))

    drifts = F.col("field").isin([f for f in fields if READINGS[f].drifts])
    counts = counts.withColumn("_all", F.sum("n").over(one)).withColumn("_m", median("step"))
    counts = counts.withColumn("usual", F.when(drifts, F.min("_m").over(one)).otherwise(F.lit(0.0)))
    counts = counts.withColumn("_far", F.abs(F.col("step") - F.col("usual"))).withColumn("_m", median("_far"))
    found = counts.groupBy("machine_id", "field").agg(F.max("usual").alias("usual"), F.min("_m").alias("scatter"))
    of = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c))).alias(f"_{c}_{f}")
    return found.groupBy("machine_id").agg(*[of(f, c) for f in fields for c in ("usual", "scatter")])


def implausible_readings(events: DataFrame, fields: tuple[str, ...] = tuple(READINGS), times: DataFrame | None = None) -> DataFrame:
    """event_id, machine_id, epoch_s, reading_field, reading, state, probability of every reading that isn't normal.

    events have event_id, machine_id, epoch_s and the fields as doubles; NULL is no reading. Readings are in order of
    epoch_s, then event_id. state is out_of_range (beyond hard bounds), stuck (at least STUCK successive readings with one
    number) or spike (up to TOGETHER successive readings away from the others); probability is that of the state. A
    machine with fewer than three readings has no spikes. Events without a machine or time have no part. An empty table
    gives an empty table. times (machine_id, epoch_s) holds at least the events' times, where they can be read more
    cheaply than from events: only the cuts of large machines, and no result, depend on them.

    Which machines are cut is read first, see shards.
    """
    rows = events.select("event_id", "machine_id", "epoch_s", *fields).where("machine_id is not null and epoch_s is not null")
    cuts = cuts_of(rows if times is None else times, "machine_id", "epoch_s")
    place = ["event_id", "machine_id", "epoch_s", *fields]
    if cuts is None:
        return _judged(rows.select(*place, F.lit(-1).cast("bigint").alias("_shard"), F.lit(True).alias("_own")).repartition("machine_id", "_shard"), list(fields))
    shard, within = F.floor(F.col("_piece") / SHARD).cast("bigint"), F.pmod("_piece", F.lit(SHARD))
    copy = lambda s, own: F.struct(s.alias("_shard"), F.lit(own).alias("_own"))
    places = F.array_compact(
        F.array(
            copy(shard, True),
            F.when((F.col("_piece") >= 0) & (within == SHARD - 1), copy(shard + 1, False)),
            F.when((F.col("_piece") > 0) & (within == 0), copy(shard - 1, False)),
        )
    )
    spread = with_piece(rows, cuts, "epoch_s", PIECE).select(*place, F.explode(places).alias("_place")).select(*place, "_place._shard", "_place._own")
    if not cuts.named:
        habits = _habits(spread.where("_shard >= 0").repartition("machine_id", "_shard"), list(fields))
        return _judged(spread.join(habits, "machine_id", "left").repartition("machine_id", "_shard"), list(fields))
    # one shuffle serves both readings of the shards: this filter, as it depends on the partition, stays above it
    shards, here = spread.repartition("machine_id", "_shard"), F.spark_partition_id()
    habits = _habits(shards.where(F.coalesce("_shard", F.lit(-1)) + here >= here), list(fields))
    return _judged(shards.join(F.broadcast(habits), "machine_id", "left"), list(fields))


def _judged(shards: DataFrame, fields: list[str]) -> DataFrame:
    return shipped(shards).sortWithinPartitions("machine_id", "_shard", "epoch_s", "event_id").mapInArrow(_flag(fields), OUT)
