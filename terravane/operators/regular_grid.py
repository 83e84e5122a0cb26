"""Irregular readings onto a regular grid, missing periods filled by singular-spectrum imputation.

Slot k of a source covers ``step * k <= t < step * (k + 1)``. Readings are bucketed to slots; the slots
without reading between a source's first and last one are filled and marked. Filling is iterative
singular-spectrum imputation: the bucketed series is embedded into a Hankel trajectory matrix, the
matrix is truncated to its leading singular vectors, averaged back over its anti-diagonals, and only
the missing entries are replaced, until they no longer change. Start values are linear. There is no
bound on the rounds: a round lowers the squared distance of the trajectory matrix to its truncation by
at least the squared change of each missing entry, so changes above the tolerance come to an end.

Work is done in blocks of slots, by one rule for gaps of any length. A block of ``SLOTS`` slots sees
``HALO`` more slots on either side, so a gap at its edge is filled from the readings of both blocks, and
two anchors: the last reading before and the first after what it sees, however far away. Start values
are the lines between what is known. Blocks that hold no reading are blocks like any other. ``how`` says
what became of a slot: ``read``; ``ssa`` where the imputation ran and converged; ``linear`` where there
was nothing to decompose, that is where the block sees no reading at all (a line is what truncation
leaves of a line), fewer than six slots, or values without any spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.blocks import BLOCK, HOME, array, codes, finite, number, run_kernel, starts, with_blocks

SLOTS, HALO = 1024, 128


def fill_linear(x: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """The series with missing entries on the line between their neighbours."""
    known = np.flatnonzero(~missing)
    return np.interp(np.arange(len(x)), known, x[known]) if len(known) else np.zeros(len(x))


def decomposable(start: np.ndarray, missing: np.ndarray, window: int = 24) -> bool:
    """Whether imputation has something to work on: a known entry, three lags, some spread."""
    return min(window, len(start) // 2) >= 3 and not missing.all() and start.std() > 0


def ssa_impute(x: np.ndarray, missing: np.ndarray, window: int = 24, rank: int = 4, tolerance: float = 1e-3, start: np.ndarray | None = None) -> np.ndarray:
    """The series with missing entries replaced by iterative singular-spectrum imputation, run until it converges.

    Missing entries begin at ``start``, without it on lines; what is not ``decomposable`` stays there.
    """
    out = (fill_linear(x, missing) if start is None else start).astype(np.float64)
    n = len(x)
    if not missing.any() or not decomposable(out, missing, window):
        return out
    window = min(window, n // 2)
    rank = min(rank, window - 1)
    centre, spread = out.mean(), out.std()
    y = (out - centre) / spread
    # values far outside the series are kept as readings, but don't shape the components
    y = np.clip(y, *(np.median(y) + np.array([-1, 1]) * 12 * (np.median(np.abs(y - np.median(y))) + 1e-9)))
    at = np.flatnonzero(missing)
    counts = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), min(window, n - window + 1))
    while True:
        hankel = np.ascontiguousarray(sliding_window_view(y, window))
        _, vectors = np.linalg.eigh(hankel.T @ hankel)
        lead = vectors[:, -rank:]
        smooth = (hankel @ lead) @ lead.T
        total = np.zeros(n)
        for j in range(window):
            total[j : j + len(smooth)] += smooth[:, j]
        new = (total / counts)[at]
        change = np.max(np.abs(new - y[at]))
        y[at] = new
        if not change >= tolerance:
            break
    out[at] = y[at] * spread + centre
    return out


def _anchors(base: DataFrame, k: int) -> DataFrame:
    """(source, block, slot, values) of the last reading before and the first after what a block sees.

    One row for each piece of ``HALO`` slots that holds a reading; the window over a source holds those.
    """
    ratio = SLOTS // HALO
    ends = ["slot", "t", *[f"v{i}" for i in range(k)]]
    pieces = base.groupBy("source", F.floor(F.col("slot") / F.lit(HALO)).alias("piece")).agg(F.min(F.struct(*ends)).alias("first"), F.max(F.struct(*ends)).alias("last"))
    order = Window.partitionBy("source").orderBy("piece")
    gaps = pieces.select("source", F.col("piece").alias("p"), F.col("last").alias("before"), F.lead("piece").over(order).alias("q"), F.lead("first").over(order).alias("after")).where("q IS NOT NULL")
    # a block sees the pieces ratio * block - 1 to ratio * block + ratio
    spans = ((f"floor((p + 1) / {ratio}) + 1", f"floor((q + 1) / {ratio})", "before"), (f"floor((p - {ratio + 1}) / {ratio}) + 1", f"floor((q - {ratio + 1}) / {ratio})", "after"))
    found = F.concat(*[F.expr(f"if({a} <= {b}, transform(sequence({a}, {b}), b -> struct(b AS block, {end} AS reading)), array())") for a, b, end in spans])
    return gaps.select("source", F.explode(found).alias("x")).select("source", F.col("x.block").alias(BLOCK), "x.reading.*")


def regular_series(df: DataFrame, source: str, time: str, fields: list[str], needed: list[str], event: str, step: float) -> DataFrame:
    """(source, slot_no, slot_start, n_readings, fields..., filled, how) for all slots of each source.

    A reading is a row whose time and ``needed`` columns are neither null nor NaN; the fields are among
    them. Rows that repeat another in source, event, time and fields count once. A slot's value is the
    mean of its readings. ``how`` is ``read``, ``ssa`` or ``linear``. An empty table gives no rows, a
    source with one slot gives that slot; other columns are not read.
    """
    slot = F.floor(number(time) / F.lit(float(step)))
    base = df.where(F.col(source).isNotNull() & finite(time, *needed)).select(
        F.col(source).cast("string").alias("source"), slot.alias("slot"), F.coalesce(F.col(event).cast("long"), F.lit(-1)).alias("event"), number(time).alias("t"), *[number(f).alias(f"v{i}") for i, f in enumerate(fields)]
    )
    k = len(fields)
    seen = with_blocks(base, "slot", SLOTS, HALO).withColumn("anchor", F.lit(False)).drop(HOME)
    rows = seen.unionByName(_anchors(base, k).withColumn("event", F.lit(-1).cast("long")).withColumn("anchor", F.lit(True)))

    def kernel(table: pa.Table) -> pa.Table | None:
        code, sources = codes(table, "source")
        block, slot_no, t, events, anchor = (array(table, n) for n in (BLOCK, "slot", "t", "event", "anchor"))
        values = [array(table, f"v{i}") for i in range(k)]
        first = np.flatnonzero(starts(code, block))
        parts: list[tuple] = []
        for a, b in zip(first, [*first[1:], len(t)]):
            low, high = block[a] * SLOTS - HALO, (block[a] + 1) * SLOTS + HALO
            once = a + np.flatnonzero(starts(t[a:b], events[a:b], anchor[a:b], *[v[a:b] for v in values]) & ~anchor[a:b])
            beyond = a + np.flatnonzero(anchor[a:b])
            # without an anchor on a side, the source begins or ends with a reading that the block sees
            if not (slot_no[beyond] < low).any():
                low = slot_no[once].min()
            if not (slot_no[beyond] >= high).any():
                high = slot_no[once].max() + 1
            n, at = int(high - low), slot_no[once] - low
            own = slice(int(max(block[a] * SLOTS - low, 0)), int(max(min((block[a] + 1) * SLOTS, high) - low, 0)))
            if own.start >= own.stop:
                continue
            count = np.bincount(at, minlength=n)
            missing = count == 0
            known = np.flatnonzero(~missing)
            filled, ran = [], np.zeros(n, dtype=bool)
            for v in values:
                x = np.bincount(at, weights=v[once], minlength=n) / np.maximum(count, 1)
                places, heights = np.append(known, slot_no[beyond] - low), np.append(x[known], v[beyond])
                sorting = np.argsort(places)
                line = np.interp(np.arange(n), places[sorting], heights[sorting])
                if missing[own].any():
                    ran |= decomposable(line, missing)
                    line = ssa_impute(x, missing, start=line)
                filled.append(line[own])
            how = np.where(~missing, "read", np.where(ran, "ssa", "linear"))[own]
            parts.append((np.full(own.stop - own.start, code[a]), (low + np.arange(n))[own], count[own], how, *filled))
        if not parts:
            return None
        joined = [np.concatenate([p[i] for p in parts]) for i in range(4 + k)]
        out = {
            "source": pa.DictionaryArray.from_arrays(pa.array(joined[0]), pa.array(sources, pa.string())).cast(pa.string()),
            "slot_no": joined[1].astype(np.int64),
            "n_readings": joined[2].astype(np.int64),
            "how": joined[3],
        }
        out |= {f"v{i}": joined[4 + i] for i in range(k)}
        return pa.table(out)

    types = ", ".join(f"v{i} double" for i in range(k))
    series = run_kernel(rows, "source", ["anchor", "t", "event", *[f"v{i}" for i in range(k)]], kernel, f"source string, slot_no bigint, n_readings bigint, how string, {types}")
    return series.select(
        F.col("source").alias(source), "slot_no", (F.col("slot_no") * F.lit(float(step))).alias("slot_start"), "n_readings", *[F.col(f"v{i}").alias(f) for i, f in enumerate(fields)], (F.col("how") != "read").alias("filled"), "how"
    )
