"""Attributes as they were known at an event's time.

Evidence counts from the instant it is both in effect and known. Of what counts, the evidence of the latest day holds.
Entities with very many events are cut into shards of time by density, see shards; each shard gets the best evidence of
all earlier shards as its carry-in, so that every shard is merged on its own and no entity needs one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.shards import cuts_of, pieces, with_piece

#: Events of a shard.
PIECE = 50_000


def as_known(events: DataFrame, evidence: DataFrame, value: str, times: DataFrame | None = None) -> DataFrame:
    """events (with machine_id and epoch_s) and known_{value}: the value by evidence on hand then, NULL where there is none.

    evidence is what usable_evidence gives. It has a part from the later of its event_date's first instant and its
    _ingested_at on; without an _ingested_at it never became known. Evidence of the same instant as the event counts. If
    evidence of one day disagrees, the greater value stands (callers leave disputed machines out). Events are never
    dropped or repeated: those without machine_id or epoch_s get NULL. Columns of events keep their names and values.
    times (machine_id, epoch_s) may name a superset of the events' times, where that can be read more cheaply than events;
    no result depends on the cuts made from it.
    """
    known_at = F.greatest(F.unix_date("event_date").cast("bigint") * 86_400 * 1_000_000, F.unix_micros(F.col("_ingested_at").cast("timestamp")))
    facts = (
        evidence.where("_ingested_at is not null and machine_id is not null and event_date is not null")
        .select(F.col("machine_id").alias("_m"), known_at.alias("_at"), F.struct(F.col("event_date").alias("d"), F.col(value).alias("v")).alias("_fact"))
        .groupBy("_m", "_at")
        .agg(F.max("_fact").alias("_fact"))
    )
    asked = events.select(
        F.struct(*[F.col(c) for c in events.columns]).alias("_row"),
        F.col("machine_id").alias("_m"),
        (F.col("epoch_s") * 1_000_000).cast("bigint").alias("_at"),
    )
    cuts = cuts_of((events if times is None else times).select(F.col("machine_id").alias("_m"), "epoch_s"), "_m", "epoch_s")
    second = F.floor(F.col("_at") / F.lit(1_000_000)).cast("bigint")
    placed = lambda df: with_piece(df.withColumn("_second", second), cuts, "_second", PIECE).drop("_second")
    facts, asked = placed(facts), placed(asked)
    # what can't be known is spread instead of gathered
    asked = asked.withColumn("_piece", F.when(F.col("_m").isNull() | F.col("_at").isNull(), -2 - F.pmod(F.xxhash64("_row"), F.lit(4096))).otherwise(F.col("_piece")))
    merged = facts.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))
    if cuts is not None:  # the best evidence of all shards before, for every shard: a row per machine and shard
        best = facts.where("_piece >= 0").groupBy("_m", "_piece").agg(F.max("_fact").alias("_fact"))
        every = pieces(cuts, PIECE).unionByName(best, allowMissingColumns=True).groupBy("_m", "_piece").agg(F.max("_fact").alias("_fact"))
        before = F.max("_fact").over(W.partitionBy("_m").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
        carried = every.select("_m", "_piece", before.alias("_fact")).where("_fact is not null")
        merged = merged.unionByName(carried, allowMissingColumns=True)
    merged = merged.unionByName(asked, allowMissingColumns=True)
    w = W.partitionBy("_m", "_piece").orderBy(F.col("_at").asc_nulls_first(), F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    out = merged.withColumn("_known", F.max("_fact").over(w)).where("_row is not null")
    return out.select("_row.*", F.when(F.col("_at").isNotNull() & F.col("_m").isNotNull(), F.col("_known.v")).alias(f"known_{value}"))
