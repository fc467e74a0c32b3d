"""Totals over trailing calendar periods, from changes instead of re-summed frames.

Each day's amount is added on its day and taken off again when the period has passed; the running sum of these changes
is the trailing total. An entity contributes a row per day of its span, however many events it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What one amount counts at most: sums of it still fit.
MOST = 1e26


def trailing_totals(amounts: DataFrame, entity: str, day: str, amount: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """entity, day, and total_{n}d (decimal) and avg_{n}d (double) for each n of periods, for every day from the entity's first to its last.

    The period of n days ends with the day itself; days before the first count as 0. A NULL amount counts as 0, yet its
    day counts for the span; rows without an entity or a day have no part. An empty table gives an empty table. Amounts
    are exact to a millionth, so that what is added and taken off cancels; the totals of amounts beyond 10**26 are 10**26.
    """
    bounded = F.greatest(F.least(F.coalesce(F.col(amount).cast("double"), F.lit(0.0)), F.lit(MOST)), F.lit(-MOST))
    daily = (
        amounts.select(F.col(entity).alias("_k"), F.col(day).alias("_d"), bounded.cast("decimal(33,6)").alias("_a"))
        .where("_k is not null and _d is not null")
        .groupBy("_k", "_d")
        .agg(F.sum("_a").alias("_a"))
    )
    # each day with an amount also makes the quiet days up to the next, so that all rows come from one reading of the amounts
    daily = daily.withColumn("_next", F.lead("_d").over(W.partitionBy("_k").orderBy("_d")))
    amount, zero = F.col("_a").cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)")
    until = F.coalesce(F.date_sub("_next", 1), F.col("_d"))
    adds = F.transform(F.sequence("_d", until), lambda d: F.struct(d.alias("d"), F.lit(True).alias("_in"), *[F.when(d == F.col("_d"), amount).otherwise(zero).alias(f"c{n}") for n in periods]))
    takes = [F.struct(F.date_add("_d", n).alias("d"), F.lit(False).alias("_in"), *[(-amount if m == n else zero).alias(f"c{m}") for m in periods]) for n in periods]
    changes = daily.select("_k", F.explode(F.concat(adds, F.array(*takes))).alias("_c")).select("_k", "_c.*")
    per_day = changes.groupBy("_k", "d").agg(*[F.sum(f"c{n}").alias(f"c{n}") for n in periods], F.max("_in").alias("_in"))
    running = W.partitionBy("_k").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    totals = per_day.select("_k", "d", "_in", *[F.sum(f"c{n}").over(running).alias(f"total_{n}d") for n in periods]).where("_in")
    return totals.select(
        F.col("_k").alias(entity),
        F.col("d").alias(day),
        *[F.col(f"total_{n}d").cast("decimal(38,6)").alias(f"total_{n}d") for n in periods],
        *[(F.col(f"total_{n}d").cast("double") / n).alias(f"avg_{n}d") for n in periods],
    )
