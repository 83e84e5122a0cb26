"""Neighbour, fill and running functions of long sequences, in blocks.

A window over a whole entity would sort all of its rows in one task. Here a window never spans more
than a block of the order axis; what a block needs from the ones before or after it (the last row, the
last value that is not null, the sum so far) comes from one summary row for each block. Rows are
exchanged once, by (entity, block); the summary is aggregated from that same exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.blocks import BLOCK


def with_context(
    df: DataFrame,
    entity: list[str],
    order: list[str],
    length: float,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    last: dict[str, str] | None = None,
    upcoming: dict[str, str] | None = None,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds columns from an entity's other rows, in the order of ``order`` (its first column is numeric).

    previous, following: value of the row before, after. last: latest value that is not null, of this
    row or before; upcoming: the same ahead. running: sum of an expression up to and with this row.
    Keys are the new columns, values name the columns they come from.
    """
    previous, following, last, upcoming, running = (x or {} for x in (previous, following, last, upcoming, running))
    base = df.withColumn(BLOCK, F.floor(F.col(order[0]) / F.lit(float(length))))
    for name, expression in running.items():
        base = base.withColumn(f"__r_{name}", expression)
    base = base.repartition(*entity, BLOCK)
    place = F.struct(*order)
    summaries = [F.max_by(F.col(c), place).alias(f"__p_{n}") for n, c in previous.items()]
    summaries += [F.min_by(F.col(c), place).alias(f"__f_{n}") for n, c in following.items()]
    summaries += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__l_{n}") for n, c in last.items()]
    summaries += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__u_{n}") for n, c in upcoming.items()]
    summaries += [F.sum(f"__r_{n}").alias(f"__s_{n}") for n in running]
    before = Window.partitionBy(*entity).orderBy(BLOCK)
    behind = before.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*entity).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = base.groupBy(*entity, BLOCK).agg(*summaries).select(
        *entity,
        BLOCK,
        *[F.lag(f"__p_{n}").over(before).alias(f"__p_{n}") for n in previous],
        *[F.lead(f"__f_{n}").over(before).alias(f"__f_{n}") for n in following],
        *[F.last(f"__l_{n}", ignorenulls=True).over(behind).alias(f"__l_{n}") for n in last],
        *[F.last(f"__u_{n}", ignorenulls=True).over(ahead).alias(f"__u_{n}") for n in upcoming],
        *[F.coalesce(F.sum(f"__s_{n}").over(behind), F.lit(0)).alias(f"__s_{n}") for n in running],
    )
    inside = Window.partitionBy(*entity, BLOCK).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    # what lies ahead is behind in the reverse order: a frame to the end would be built anew for each row
    reverse = Window.partitionBy(*entity, BLOCK).orderBy(*[F.col(c).desc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    first, final = F.row_number().over(inside) == 1, F.lead(F.lit(1)).over(inside).isNull()
    joined = base.join(carried, [*entity, BLOCK])
    added: dict[str, Column] = {}
    for n, c in previous.items():
        added[n] = F.when(first, F.col(f"__p_{n}")).otherwise(F.lag(c).over(inside))
    for n, c in following.items():
        added[n] = F.when(final, F.col(f"__f_{n}")).otherwise(F.lead(c).over(inside))
    for n, c in last.items():
        added[n] = F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"__l_{n}"))
    for n, c in upcoming.items():
        added[n] = F.coalesce(F.last(c, ignorenulls=True).over(reverse), F.col(f"__u_{n}"))
    for n in running:
        added[n] = F.sum(f"__r_{n}").over(so_far) + F.col(f"__s_{n}")
    return joined.select(*df.columns, *[c.alias(n) for n, c in added.items()])
