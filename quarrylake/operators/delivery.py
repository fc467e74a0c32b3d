"""Exactly one copy of each message that was delivered at least once.

Identifiers that a producer numbers (`E000007840`) are kept as disjoint ranges of numbers seen, not as a list of keys: a
number outside the ranges is accepted once and merged into them. Other identifiers are looked up by their exact key, in a
table of keys. Ranges and keys are what one batch hands to the next.

The number space of a producer is cut into blocks, each with ranges of its own, so that a busy producer spreads over the
cluster. Deliveries are judged twice: where they lie first, so that a message delivered very often sends one row per
task, then by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.functions.reading import text_of
from quarrylake.functions.shipping import shipped

BLOCK = 1 << 16
_NUMBERED = r"\A([A-Za-z][A-Za-z_-]{0,15})([0-9]{1,18})\z"


def producer_of(c: Column) -> Column:
    """Prefix and width of a numbered identifier; NULL of any other. The width tells E01 from E1."""
    prefix, digits = F.regexp_extract(c, _NUMBERED, 1), F.regexp_extract(c, _NUMBERED, 2)
    return F.when(prefix != "", F.concat_ws("#", prefix, F.length(digits).cast("string")))


def number_in(c: Column) -> Column:
    return F.regexp_extract(c, _NUMBERED, 2).try_cast("bigint")


class Ranges:
    """Disjoint closed ranges of whole numbers, sorted."""

    def __init__(self) -> None:
        self.lo = self.hi = np.empty(0, np.int64)

    def cover(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lo, x, "right") - 1
        return (at >= 0) & (x <= self.hi[np.maximum(at, 0)]) if len(self.lo) else np.zeros(len(x), bool)

    def add(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Take in ranges; what overlaps or adjoins becomes one."""
        lo, hi = np.concatenate([self.lo, lo]), np.concatenate([self.hi, hi])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        first = np.ones(len(lo), bool)
        first[1:] = lo[1:] > hi[:-1] + 1
        self.lo, self.hi = lo[first], hi[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)] if len(lo) else hi


#: Marks the producer of an identifier that isn't numbered: the identifier itself, with the only number 0.
_KEYED = "="


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets _again on numbers that the ranges cover already; rows that have it pass.

    Rows come by producer and block, what was seen before first, then deliveries by preference. Of a keyed identifier the
    first row is kept: a delivery, or the key as it was seen before.
    """
    at, seen, last = None, Ranges(), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        again = batch.column("_again").to_numpy(zero_copy_only=False).copy()
        open_rows = np.flatnonzero(~again)
        if len(open_rows):
            rows = batch if len(open_rows) == n else batch.take(pa.array(open_rows))
            key = rows.column("_producer").dictionary_encode()
            code, names = key.indices.to_numpy(), key.dictionary.to_pylist()
            by_key = np.array([x[0] == _KEYED for x in names])[code]
            block, number, until = (rows.column(c).to_numpy() for c in ("_block", "_number", "_until"))
            repeat = np.zeros(len(code), bool)
            repeat[1:] = code[1:] == code[:-1]
            repeat[0] = names[code[0]] == last
            last = names[code[-1]]
            judged = by_key & repeat
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
            starts = np.r_[0, cuts]
            ends = np.r_[cuts, len(code)]
            for a, z in zip(starts[~by_key[starts]], ends[~by_key[starts]]):
                if (here := (names[code[a]], block[a])) != at:
                    at, seen = here, Ranges()
                old = until[a:z] >= 0
                if old.any():
                    seen.add(number[a:z][old], until[a:z][old])
                x = number[a:z]
                covered = seen.cover(x)
                first = np.zeros(z - a, bool)
                fresh = np.flatnonzero(~old)
                first[fresh[np.unique(x[fresh], return_index=True)[1]]] = True
                judged[a:z] = ~old & (covered | ~first)
                new = np.sort(x[first & ~covered])
                if len(new):
                    seen.add(new, new)
            again[open_rows] = judged
        yield batch.set_column(batch.schema.get_field_index("_again"), "_again", pa.array(again))


def _pass(rows: DataFrame, *prefer: Column) -> DataFrame:
    return shipped(rows).sortWithinPartitions("_producer", "_block", F.col("_until").desc(), *prefer).mapInArrow(_judge, rows.schema)


def judge_deliveries(rows: DataFrame, key: str, prefer: list[str], seen: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """key, the prefer columns, and `again`: true for every delivery but the one kept of each key.

    Of a key's deliveries the one with the greatest prefer columns is kept (NULL last); prefer must tell all apart.
    seen (producer, first, last) are ranges taken in before, and keys (key) the identifiers without a number: deliveries
    within them are all again. Keys are compared without surrounding blanks; a delivery without key can't be known again
    and is left out. An empty table gives an empty table.

    Deliveries that are judged again where they lie go to any task of the second pass, the others to that of their block.
    """
    base = rows.select(text_of(F.col(key)).alias(key), *prefer).where(F.col(key).isNotNull())
    producer, number = producer_of(F.col(key)), F.coalesce(number_in(F.col(key)), F.lit(0))
    base = base.withColumns({"_producer": F.coalesce(producer, F.concat(F.lit(_KEYED), key)), "_number": number})
    base = base.withColumns({"_block": F.expr(f"_number div {BLOCK}"), "_until": F.lit(-1).cast("bigint"), "_again": F.lit(False)})
    order = [F.col(c).desc_nulls_last() for c in prefer]
    here = _pass(base, *order)
    if seen is not None:
        block = F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}")))
        old = seen.select(F.col("producer").alias("_producer"), "first", "last", block.alias("_block")).select(
            "_producer", "_block", F.greatest("first", F.col("_block") * BLOCK).alias("_number"), F.least("last", (F.col("_block") + 1) * BLOCK - 1).alias("_until")
        )
        here = here.unionByName(old.withColumn("_again", F.lit(False)), allowMissingColumns=True)
    if keys is not None:
        zero = F.lit(0).cast("bigint")
        old = keys.select(F.concat(F.lit(_KEYED), "key").alias("_producer"), zero.alias("_number"), zero.alias("_block"), zero.alias("_until"), F.lit(False).alias("_again"))
        here = here.unionByName(old.where("_producer is not null"), allowMissingColumns=True)
    place = F.when(F.col("_again"), F.xxhash64(key, *prefer)).otherwise(F.xxhash64("_producer", "_block"))
    judged = _pass(here.withColumn("_place", place).repartition("_place"), *order).where("_until < 0")
    return judged.select(key, *prefer, F.col("_again").alias("again"))


def seen_keys(accepted: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """key: the identifiers without a number after the accepted ones are added to those seen before, each once."""
    text = text_of(F.col(key))
    ids = accepted.select(text.alias("key")).where(F.col("key").isNotNull() & producer_of(F.col("key")).isNull())
    return (ids if keys is None else ids.unionByName(keys.select("key"))).distinct()


def seen_ranges(accepted: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """producer, first, last: the disjoint ranges after the accepted keys are merged into those seen before.

    Runs form within blocks; the few that reach a block's edge are merged across. Identifiers without a number are for
    seen_keys.
    """
    ids = accepted.select(producer_of(text_of(F.col(key))).alias("producer"), number_in(text_of(F.col(key))).alias("first")).where("producer is not null")
    points = ids.select("producer", "first", F.col("first").alias("last"))
    if seen is not None:
        points = points.unionByName(seen.select("producer", "first", "last"))

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("first")
        reach = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
        runs = rows.withColumn("_new", F.when(F.col("first") <= reach + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return runs.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")

    local = merged(points.withColumn("_block", F.expr(f"first div {BLOCK}")), "producer", "_block").drop("_block")
    return merged(local, "producer").select("producer", "first", "last")
