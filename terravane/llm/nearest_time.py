"""Nearest record in time, by tick expansion.

The time axis is cut into ticks of half the tolerance. Every right record is exploded to each tick that
holds a moment within the tolerance of it. For each entity-tick only what can be nearest to some moment
of the tick is kept: the last record before the tick, the first one after it, and, as left times vary
inside a tick, the records in it, of which there is one at most where records are further apart than a
tick. Left records then meet their tick by an equi-join and take the nearest of what was kept.

(entity, tick) is the only exchange key, so an entity with a third of all rows is spread over its
ticks, and the aggregations after the join need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators.blocks import finite, number


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    left_key: str,
    left_time: str,
    right_key: str,
    right_time: str,
    tolerance: float,
    tick: float | None = None,
) -> DataFrame:
    """(entity, left_key, right_key, gap) for each left record that has a right one within tolerance.

    Records whose entity, key or time is null or NaN take no part. Repeated records count once. Of
    right records at the same distance the earlier one is taken, of those at the same time the one
    with the smallest key. A left key that comes with several times gives its nearest pair. Empty
    tables give no rows; other columns are not read, whatever their names.
    """
    width = float(tick or tolerance / 2)
    least = F.lit(float(tolerance))
    tick_of = lambda c: F.floor(c / F.lit(width))
    rights = right.where(F.col(entity).isNotNull() & F.col(right_key).isNotNull() & finite(right_time)).select(
        F.col(entity).alias("e"), number(right_time).alias("rt"), F.col(right_key).alias("rk")
    )
    # a margin, so that rounding at a tick's edge loses nothing; distances are tested exactly below
    reach = F.lit(float(tolerance) * 1.000001 + 1e-9)
    expanded = rights.withColumn("tick", F.explode(F.sequence(tick_of(F.col("rt") - reach), tick_of(F.col("rt") + reach))))
    side = F.when(F.col("tick") > tick_of(F.col("rt")), -1).when(F.col("tick") < tick_of(F.col("rt")), 1).otherwise(0)
    once = expanded.repartition("e", "tick").groupBy("e", "tick", "rt").agg(F.min("rk").alias("rk")).withColumn("side", side)
    kept = (
        once.withColumn("inside", F.when(F.col("side") == 0, F.col("rt")))
        .groupBy("e", "tick", "side", "inside")
        .agg(
            F.when(F.col("side") < 0, F.max("rt")).otherwise(F.min("rt")).alias("rt"),
            F.when(F.col("side") < 0, F.max_by("rk", "rt")).otherwise(F.min_by("rk", "rt")).alias("rk"),
        )
        .select("e", "tick", "rt", "rk")
    )
    lefts = (
        left.where(F.col(entity).isNotNull() & F.col(left_key).isNotNull() & finite(left_time))
        .select(F.col(entity).alias("e"), number(left_time).alias("lt"), F.col(left_key).alias("lk"))
        .withColumn("tick", tick_of(F.col("lt")))
        .repartition("e", "tick")
    )
    gap = F.abs(F.col("lt") - F.col("rt"))
    pairs = lefts.hint("shuffle_hash").join(kept, ["e", "tick"]).withColumn("gap", gap).where(F.col("gap") <= least)
    # first inside a tick, where no exchange is needed, then over the times of a key
    best = pairs.groupBy("e", "tick", "lk").agg(F.min(F.struct("gap", "rt", "rk")).alias("best"))
    return (
        best.groupBy("e", "lk")
        .agg(F.min("best").alias("best"))
        .select(F.col("e").alias(entity), F.col("lk").alias(left_key), F.col("best.rk").alias(right_key), F.col("best.gap").alias("gap"))
    )
