"""Repeated consecutive events: optimal segmentation of ordered sequences.

A segmentation of one entity's events into runs costs, for each run, the dissimilarities of its
neighbours and ``level_weight`` times the squared distances of its events to the run's level (its
mean), plus ``penalty`` for each run. Distances are in units of each field's tolerance; of two
neighbours the field with the largest difference counts. The level term keeps a slow drift from being
one run; without it and with a penalty of 1 a boundary pays exactly where some field differs from the
event before by more than its tolerance.

``segment`` is the dynamic programme F(t) = min over s <= t of F(s-1) + cost(s, t) + penalty. Candidates
are pruned: a start s with F(s-1) + cost(s, t) >= F(t) never wins later, as splitting a run never raises
its cost; and without the level term all starts pay the same from then on, so a start that is not the
cheapest, or is as cheap as an earlier one, is dominated. Costs are kept relative to the cheapest, so
that long sequences lose no digits.

Without the level term costs add over neighbours, so the programme runs over whole blocks of the order
axis (see ``operators.blocks``), finds all their boundaries, and the run at a block's edge is carried on
by the same comparison. With it a boundary is still certain where two neighbours differ by more than the
penalty, so the programme falls into independent chains there. A chain is one unit: chains are numbered
blockwise and exchanged by (entity, chain), so that an entity is still spread over its chains; a chain
without any certain boundary is held by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.blocks import BLOCK, array, codes, finite, number, run_kernel, starts, with_blocks
from terravane.operators.sequences import with_context


def segment(distance: np.ndarray, points: np.ndarray, penalty: float, level_weight: float) -> list[int]:
    """Starts of the runs of the cheapest segmentation of one sequence; of equally cheap ones that with the longest last runs.

    ``distance[i]`` is the dissimilarity of event i to event i-1, ``points`` has a row of fields for each event.
    """
    back = _level_steps(distance, points, penalty, level_weight) if level_weight else _additive_steps(distance, penalty)
    out, t = [], len(distance) - 1
    while t >= 0:
        out.append(int(back[t]))
        t = out[-1] - 1
    return out[::-1]


def _additive_steps(distance: np.ndarray, penalty: float) -> list[int]:
    """For each event the start of the cheapest last run that ends there, without the level term."""
    back: list[int] = []
    starts_at: list[int] = []
    paid: list[float] = []
    for t, d in enumerate(distance.tolist()):
        starts_at.append(t)
        paid = [*(p + d for p in paid), penalty]
        least = paid.index(min(paid))
        back.append(starts_at[least])
        starts_at, paid = [starts_at[least]], [0.0]
    return back


def _level_steps(distance: np.ndarray, points: np.ndarray, penalty: float, level_weight: float) -> np.ndarray:
    """The same with the level term."""
    n = len(distance)
    points = points - points[0]
    sums = np.vstack([np.zeros(points.shape[1]), np.cumsum(points, axis=0)])
    squares = np.append(0.0, np.cumsum((points**2).sum(axis=1)))
    back = np.zeros(n, dtype=np.int64)
    starts_at, paid = np.zeros(0, dtype=np.int64), np.zeros(0)
    for t in range(n):
        starts_at, paid = np.append(starts_at, t), np.append(paid + distance[t], penalty)
        spread = squares[t + 1] - squares[starts_at] - ((sums[t + 1] - sums[starts_at]) ** 2).sum(axis=1) / (t + 1 - starts_at)
        total = paid + level_weight * np.maximum(spread, 0.0)
        least = int(np.argmin(total))
        best, back[t] = total[least], starts_at[least]
        kept = total - penalty < best
        starts_at, paid = starts_at[kept], paid[kept] - best
    return back


def best_starts(distance: np.ndarray, fresh: np.ndarray, points: np.ndarray, penalty: float, level_weight: float = 0.0) -> np.ndarray:
    """True where a run of the optimal segmentation begins; ``fresh`` marks the first event of each sequence.

    Only with the level term, whose candidates are many, are sequences cut at certain boundaries beforehand.
    """
    out = fresh | (distance > penalty) if level_weight else fresh.copy()
    begin = np.flatnonzero(out)
    end = np.append(begin[1:], len(out))
    for a, b in zip(begin, end):
        if b - a > 1:
            d = distance[a:b].copy()
            d[0] = 0.0
            out[a + np.array(segment(d, points[a:b], penalty, level_weight))] = True
    return out


def collapse_runs(
    df: DataFrame,
    entity: str,
    order: str,
    event: str,
    tolerances: dict[str, float],
    penalty: float = 1.0,
    level_weight: float = 0.0,
    min_events: int = 1,
    block: float = 3600.0,
) -> DataFrame:
    """One row for each run: (entity, first_event, last_event, n_events, start, end, duration).

    Events are the rows whose order and fields are all neither null nor NaN; rows that repeat another
    in entity, event, order and fields count once; ties in order follow the event id. Runs of fewer
    than ``min_events`` are left out, inside a block already in the kernel. Two equal infinite values are
    no neighbours, as their difference is no number. An empty table gives no rows; other columns are
    not read.
    """
    names = list(tolerances)
    base = df.where(F.col(entity).isNotNull() & F.col(event).isNotNull() & finite(order, *names)).select(
        F.col(entity).cast("string").alias("entity"), F.col(event).cast("long").alias("event"), number(order).alias("t"), *[number(n).alias(f"v{i}") for i, n in enumerate(names)]
    )
    limits = [float(tolerances[n]) for n in names]
    k = len(names)

    def kernel(table: pa.Table) -> pa.Table | None:
        code, entities = codes(table, "entity")
        block_no, t, ids = array(table, BLOCK), array(table, "t"), array(table, "event")
        values = [array(table, f"v{i}") for i in range(k)]
        kept = np.flatnonzero(starts(code, block_no, t, ids, *values))
        code, block_no, t, ids, values = code[kept], block_no[kept], t[kept], ids[kept], [v[kept] for v in values]
        fresh = starts(code, block_no)
        distance = np.zeros(len(t))
        with np.errstate(invalid="ignore"):
            for v, limit in zip(values, limits):
                distance[1:] = np.maximum(distance[1:], np.abs(np.diff(v)) / limit)
        distance[np.isnan(distance)] = np.inf
        points = np.stack([v / limit for v, limit in zip(values, limits)], axis=1)
        begin = np.flatnonzero(best_starts(distance, fresh, points, penalty, level_weight))
        end = np.append(begin[1:], len(t)) - 1
        head = fresh[begin]
        tail = np.append(head[1:], True)
        if level_weight:
            head = tail = np.zeros(len(begin), dtype=bool)
        lasting = (end - begin + 1 >= min_events) | head | tail
        begin, end, head, tail = begin[lasting], end[lasting], head[lasting], tail[lasting]
        out = {
            "entity": pa.DictionaryArray.from_arrays(pa.array(code[begin]), pa.array(entities, pa.string())).cast(pa.string()),
            "block_no": block_no[begin],
            "head": head,
            "tail": tail,
            "first_event": ids[begin],
            "last_event": ids[end],
            "n_events": (end - begin + 1).astype(np.int64),
            "start": t[begin],
            "end": t[end],
        }
        out |= {f"a{i}": v[begin] for i, v in enumerate(values)} | {f"z{i}": v[end] for i, v in enumerate(values)}
        return pa.table(out)

    ends = ", ".join([f"a{i} double" for i in range(k)] + [f"z{i} double" for i in range(k)])
    runs = run_kernel(
        _with_chains(base, limits, penalty, block) if level_weight else with_blocks(base, "t", block),
        "entity",
        ["t", "event", *[f"v{i}" for i in range(k)]],
        kernel,
        f"entity string, block_no bigint, head boolean, tail boolean, first_event bigint, last_event bigint, n_events bigint, start double, `end` double, {ends}",
    )
    return _join_edges(runs, limits, penalty).where(F.col("n_events") >= min_events).select(
        F.col("entity").alias(entity), "first_event", "last_event", "n_events", "start", "end", (F.col("end") - F.col("start")).alias("duration")
    )


def _with_chains(base: DataFrame, limits: list[float], penalty: float, block: float) -> DataFrame:
    """The rows in blocks that are whole chains, numbered along their entity."""
    names = [f"v{i}" for i in range(len(limits))]
    once = base.distinct()
    order = ["t", "event", *names]
    linked = with_context(once, ["entity"], order, block, previous={f"p{i}": n for i, n in enumerate(names)})
    apart = F.greatest(*[F.abs(F.col(n) - F.col(f"p{i}")) / F.lit(limit) for i, (n, limit) in enumerate(zip(names, limits))], F.lit(0.0)) > penalty
    numbered = with_context(linked.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("long")), ["entity"], order, block, running={"chain": F.col("apart")})
    return numbered.withColumn(BLOCK, F.col("chain")).select("entity", "event", "t", *names, BLOCK)


def _join_edges(runs: DataFrame, limits: list[float], penalty: float) -> DataFrame:
    """Joins the runs that meet at block edges.

    Only the first and last run of a block can meet others. They share one window for each entity,
    two rows for each block; all other runs pass through in windows of their own block.
    """
    edge = F.col("head") | F.col("tail")
    keyed = runs.withColumn("part", F.when(edge, F.lit(-1)).otherwise(F.col("block_no"))).withColumn("edge", edge)
    order = Window.partitionBy("entity", "edge", "part").orderBy("block_no", "start", "first_event")
    near = F.lit(True)
    for i, limit in enumerate(limits):
        near = near & (F.abs(F.col(f"a{i}") - F.lag(f"z{i}").over(order)) / F.lit(limit) <= F.lit(penalty))
    joined = F.coalesce(F.col("edge") & F.col("head") & F.lag("tail").over(order) & near, F.lit(False))
    island = F.sum(F.when(joined, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        keyed.withColumn("island", island)
        .groupBy("entity", "edge", "part", "island")
        .agg(
            F.min(F.struct("block_no", "start", "first_event")).getField("first_event").alias("first_event"),
            F.max(F.struct("block_no", "end", "last_event")).getField("last_event").alias("last_event"),
            F.sum("n_events").alias("n_events"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
    )
