"""Implausible readings: spikes, stuck values and impossible values, per source.

Each source's readings are cut into blocks by their number, with a halo of readings
(``reading_blocks``), so a source that sends twice an hour has the same context as one that sends ten
times a second. For each field the steps are:

1. Physical bounds. Values outside the bounds of the field cannot be true and leave the series.
2. Hampel filter. A value is suspect where its residual to the rolling median of ``2 * half + 1``
   readings is larger than ``hampel`` times 1.4826 times the median absolute deviation of the residuals
   of the whole source, and larger than ``k`` times the median increment of the whole source (readings
   at rest left out).
3. Return. A run of at most ``longest`` suspect values is a spike where each of them is also as far
   from the line between the trusted neighbours before and after, so a turn in a gap or a shift that
   stays is none. A run at an end of the log has one neighbour only and needs ``edge_k`` increments from
   the course of the readings next to it.
4. Stuck values. Runs of equal values (run lengths) of at least ``stuck`` readings are cases from
   their second value on, where another position field moves by more than its tolerance meanwhile.

Nulls and NaN are no readings. Repeated rows count once. Rows without time are not judged. Ties in
time are ordered by the tie column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.blocks import BLOCK, HOME, array, codes, finite, number, run_kernel, starts


@dataclass(frozen=True)
class Field:
    """A judged field: physical bounds, least increment that is movement, least scale."""

    low: float
    high: float
    rest: float
    floor: float
    moved: float


@dataclass(frozen=True)
class Settings:
    half: int = 7
    hampel: float = 3.0
    k: float = 16.0
    edge_k: float = 60.0
    longest: int = 6
    stuck: int = 6


def rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    """Median of the ``2 * half + 1`` values around each; the ends repeat their mirror image."""
    if len(x) == 0:
        return x
    mode = "reflect" if len(x) > half else "edge"
    return np.median(sliding_window_view(np.pad(x, half, mode=mode), 2 * half + 1), axis=1)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Scales are medians over bins of this many to a doubling, so a source of any size gives one bounded histogram.
BINS = 64


def deviations(x: np.ndarray, field: Field, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Absolute residual of each value to its rolling median, and its absolute increment (NaN where at rest)."""
    residual = np.abs(x - rolling_median(x, settings.half))
    steps = np.full(len(x), np.nan)
    steps[1:] = np.abs(np.diff(x))
    steps[~(steps > field.rest)] = np.nan
    return residual, steps


def log_bin(x: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(x, 1e-12)) * BINS).astype(np.int64)


def median_of_bins(bins: np.ndarray) -> float:
    """The median as the middle of its bin; NaN of nothing."""
    return float(2.0 ** ((np.sort(bins)[(len(bins) - 1) // 2] + 0.5) / BINS)) if len(bins) else np.nan


def limit_of(mad: float, step: float, field: Field, settings: Settings) -> tuple[float, float]:
    """(distance of a suspect value, distance at a log's end) of a source with these medians.

    A value must be far in both scales: the median absolute deviation of the residuals, and the median
    increment. In straight flight residuals vanish, and a turn would be an outlier by the first alone.
    """
    step = max(step if step > 0 else 0.0, field.floor)
    deviation = settings.hampel * 1.4826 * (mad if mad > 0 else 0.0)
    return max(settings.k * step, deviation), max(settings.edge_k * step, deviation)


def spikes(t: np.ndarray, x: np.ndarray, field: Field, settings: Settings, limits: tuple[float, float] | None = None) -> np.ndarray:
    """Flags of impossible values and spikes of one series without nulls.

    ``limits`` are those of ``limit_of`` for the series' source; without them its own are taken.
    """
    out = (x < field.low) | (x > field.high)
    keep = np.flatnonzero(~out)
    if len(keep) < 5:
        return out
    t, x = t[keep], x[keep]
    if limits is None:
        residual, steps = deviations(x, field, settings)
        limits = limit_of(median_of_bins(log_bin(residual)), median_of_bins(log_bin(steps[~np.isnan(steps)])), field, settings)
    limit, edge_limit = limits
    suspect = np.abs(x - rolling_median(x, settings.half)) > limit
    flags = np.zeros(len(x), dtype=bool)
    for a, b in zip(*runs_of(suspect)):
        if b - a > 2 * settings.longest:
            continue
        i, j = a - 1, b
        if i >= 0 and j < len(x):
            span = max(t[j] - t[i], 1e-9)
            line = x[i] + (x[j] - x[i]) * (t[a:b] - t[i]) / span
            far = np.abs(x[a:b] - line) > limit
            if far.sum() <= settings.longest:
                flags[a:b] = far
        elif b - a <= settings.longest:
            near = x[j : j + 6] if i < 0 else x[max(0, i - 5) : i + 1][::-1]
            if len(near) >= 3:
                steps = np.arange(b - a, 0, -1) if i < 0 else np.arange(1, b - a + 1)
                course = near[0] - steps * np.median(np.diff(near))
                flags[a:b] = np.abs(x[a:b] - course) > edge_limit
    out[keep[flags]] = True
    return out


def stuck_values(series: dict[str, np.ndarray], name: str, wrong: dict[str, np.ndarray], fields: dict[str, Field], settings: Settings) -> np.ndarray:
    """Flags of the repeated values of ``name`` while another field moves."""
    x = series[name]
    index = np.flatnonzero(~np.isnan(x))
    out = np.zeros(len(x), dtype=bool)
    if len(index) < settings.stuck:
        return out
    values = x[index]
    same = np.concatenate([[False], values[1:] == values[:-1]])
    for a, b in zip(*runs_of(same)):
        if b - a + 1 < settings.stuck:
            continue
        low, high = index[a - 1], index[b - 1] + 1
        for other, field in fields.items():
            if other == name or field.moved <= 0:
                continue
            y = series[other][low:high]
            y = y[~np.isnan(y) & ~wrong[other][low:high]] if other in wrong else y[~np.isnan(y)]
            if len(y) > 1 and np.ptp(y) > field.moved:
                out[index[a:b]] = True
                break
    return out


#: A bin's readings of a field are counted as the set bits of a mask of this many, which never counts a repeated one twice.
MASK = 64


def reading_blocks(base: DataFrame, fields: list[str], readings: int, halo: int, bin_s: float) -> tuple[DataFrame, DataFrame]:
    """Rows of ``base`` (source, t, ...) in blocks by the number of readings, with a halo by the number of readings.

    Short time bins of a source are lined up to blocks of about ``readings`` rows. Whole bins of the
    neighbouring blocks are repeated until at least ``halo`` different readings of each field stand on
    either side, however far away in time they lie. The window over a source holds its bins, whose number
    is bounded by its time span. Also returns (source, block) of all blocks.
    """
    rows = base.withColumn("bin", F.floor(F.col("t") / F.lit(float(bin_s)))).repartition("source", "bin")
    bit = F.expr(f"shiftleft(1L, int(pmod(xxhash64(t), {MASK})))")
    masks = [F.bit_count(F.coalesce(F.bit_or(F.when(F.col(f).isNotNull(), bit)), F.lit(0).cast("long"))).alias(f"g_{f}") for f in fields]
    order = Window.partitionBy("source").orderBy("bin")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("source", "bin").agg(F.count("*").alias("n"), *masks)
    bins = bins.select("source", "bin", F.floor((F.sum("n").over(so_far) - F.col("n")) / F.lit(readings)).alias("own"), *[F.col(f"g_{f}") for f in fields], *[F.sum(f"g_{f}").over(so_far).alias(f"e_{f}") for f in fields])
    low, high = [F.col("own")], [F.col("own")]
    for f in fields:
        near = Window.partitionBy("source", F.col(f"g_{f}") > 0).orderBy(f"e_{f}")
        low.append(F.when(F.col(f"g_{f}") > 0, F.min("own").over(near.rangeBetween(-(halo + MASK), 0))))
        high.append(F.when(F.col(f"g_{f}") > 0, F.max("own").over(near.rangeBetween(0, halo + MASK))))
    bins = bins.select("source", "bin", "own", F.least(*low).alias("low"), F.greatest(*high).alias("high"))
    placed = rows.join(bins.hint("shuffle_hash"), ["source", "bin"])
    placed = placed.withColumn(BLOCK, F.explode(F.sequence("low", "high"))).withColumn(HOME, F.col(BLOCK) == F.col("own"))
    return placed.drop("bin", "own", "low", "high"), bins.select("source", F.col("own").alias(BLOCK)).distinct()


def _series(table: pa.Table, names: list[str], judged: dict[str, Field]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """For each block the row numbers of its readings, repeated rows once, and their values by field."""
    code, _ = codes(table, "source")
    block, t, ids = array(table, BLOCK), array(table, "t"), array(table, "tie")
    values = [array(table, f"v{i}") for i in range(len(names))]
    first = np.flatnonzero(starts(code, block))
    for a, b in zip(first, [*first[1:], len(t)]):
        repeated = ~starts(t[a:b], ids[a:b])
        for v in values:
            repeated[1:] &= (v[a + 1 : b] == v[a : b - 1]) | (np.isnan(v[a + 1 : b]) & np.isnan(v[a : b - 1]))
        rows = a + np.flatnonzero(~repeated)
        yield rows, {n: v[rows] for n, v in zip(names, values)}


def source_scales(placed: DataFrame, order: list[str], names: list[str], judged: dict[str, Field], settings: Settings) -> DataFrame:
    """(source, r0, s0, r1, s1, ...): median absolute residual and increment of each judged field of a source.

    Each block gives bounded histograms of its own readings; their sums give the medians.
    """

    def kernel(table: pa.Table) -> pa.Table | None:
        code, sources = codes(table, "source")
        home = array(table, HOME)
        parts: list[tuple] = []
        for rows, series in _series(table, names, judged):
            for i, (n, field) in enumerate(judged.items()):
                x = series[n]
                ok = np.flatnonzero((x >= field.low) & (x <= field.high))
                if not len(ok):
                    continue
                for kind, y in enumerate(deviations(x[ok], field, settings)):
                    bins, counts = np.unique(log_bin(y[home[rows[ok]] & ~np.isnan(y)]), return_counts=True)
                    parts.append((np.full(len(bins), code[rows[0]]), np.full(len(bins), 2 * i + kind), bins, counts))
        if not parts:
            return None
        owner, series_no, bins, counts = (np.concatenate([p[i] for p in parts]) for i in range(4))
        return pa.table({"source": pa.DictionaryArray.from_arrays(pa.array(owner), pa.array(sources, pa.string())).cast(pa.string()), "series": pa.array(series_no, pa.int32()), "bin": pa.array(bins, pa.int64()), "n": pa.array(counts, pa.int64())})

    counted = run_kernel(placed, "source", order, kernel, "source string, series int, bin bigint, n bigint").groupBy("source", "series", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("source", "series")
    below = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    middle = counted.withColumn("reached", below > F.floor((F.sum("n").over(whole) - 1) / 2)).where("reached").groupBy("source", "series").agg(F.pow(F.lit(2.0), (F.min("bin") + 0.5) / BINS).alias("median"))
    return middle.groupBy("source").agg(*[F.max(F.when(F.col("series") == i, F.col("median"))).alias(f"{'rs'[i % 2]}{i // 2}") for i in range(2 * len(judged))])


def implausible(
    df: DataFrame,
    source: str,
    tie: str,
    time: str,
    judged: dict[str, Field],
    witnesses: dict[str, Field],
    settings: Settings | None = None,
    readings: int = 4096,
    halo: int = 32,
    bin_s: float = 300.0,
) -> DataFrame:
    """One row (source, tie, field_name, reason) for each implausible value of the judged fields.

    reason is ``impossible``, ``spike`` or ``stuck``. ``witnesses`` are fields that only tell movement.
    Context of a value are its block of about ``readings`` rows and at least ``halo`` readings of the field
    on either side; that is more than the longest spike and its windows reach, so blocks change no spike.
    An empty table gives no rows; other columns of the table are not read, whatever their names.
    """
    settings = settings or Settings()
    names = [*judged, *witnesses]
    fields = {**judged, **witnesses}
    base = df.where(finite(time)).select(
        F.col(source).cast("string").alias("source"), F.col(tie).cast("long").alias("tie"), number(time).alias("t"), *[number(n).alias(f"v{i}") for i, n in enumerate(names)]
    )
    placed, blocks = reading_blocks(base.where(F.col("source").isNotNull()), [f"v{i}" for i in range(len(judged))], readings, halo, bin_s)
    order = ["t", "tie", *[f"v{i}" for i in range(len(names))]]
    scales = blocks.join(source_scales(placed, order, names, judged, settings), "source")
    scaled = placed.repartition("source", BLOCK).join(scales.hint("shuffle_hash"), ["source", BLOCK], "left")

    def kernel(table: pa.Table) -> pa.Table | None:
        code, sources = codes(table, "source")
        t, ids, home = array(table, "t"), array(table, "tie"), array(table, HOME)
        medians = [(array(table, f"r{i}"), array(table, f"s{i}")) for i in range(len(judged))]
        found: list[tuple[np.ndarray, np.ndarray, str, str]] = []
        for rows, series in _series(table, names, judged):
            wrong = {}
            for (n, field), (mad, step) in zip(judged.items(), medians):
                ok = np.flatnonzero(~np.isnan(series[n]))
                wrong[n] = np.zeros(len(rows), dtype=bool)
                wrong[n][ok] = spikes(t[rows][ok], series[n][ok], field, settings, limit_of(mad[rows[0]], step[rows[0]], field, settings))
            for n in judged:
                x = series[n]
                beyond = wrong[n] & ((x < fields[n].low) | (x > fields[n].high))
                stuck = stuck_values(series, n, wrong, fields, settings) & ~wrong[n]
                for reason, flags in (("impossible", beyond), ("spike", wrong[n] & ~beyond), ("stuck", stuck)):
                    hit = rows[flags & home[rows]]
                    if len(hit):
                        found.append((code[hit], ids[hit], n, reason))
        if not found:
            return None
        lengths = [len(x[0]) for x in found]
        return pa.table(
            {
                source: pa.DictionaryArray.from_arrays(pa.array(np.concatenate([x[0] for x in found])), pa.array(sources, pa.string())).cast(pa.string()),
                tie: pa.array(np.concatenate([x[1] for x in found]), pa.int64()),
                "field_name": pa.array(np.repeat([x[2] for x in found], lengths), pa.string()),
                "reason": pa.array(np.repeat([x[3] for x in found], lengths), pa.string()),
            }
        )

    return run_kernel(scaled, "source", order, kernel, f"`{source}` string, `{tie}` bigint, field_name string, reason string")


#: Bounds and tolerances of positions in degrees and metres. Either coordinate may be stored in either
#: column, so both get the bounds of a longitude.
DEGREES = Field(low=-180.0, high=180.0, rest=1.25e-6, floor=2e-6, moved=2e-5)
METRES = Field(low=-500.0, high=9000.0, rest=0.0, floor=0.05, moved=0.0)
CLIMB = Field(low=-1000.0, high=9000.0, rest=0.0, floor=0.05, moved=1.0)


def implausible_waypoints(waypoints: DataFrame) -> DataFrame:
    """``implausible`` for flight logs: latitude, longitude and absolute altitude of each survey."""
    return implausible(
        waypoints,
        "survey_id",
        "frame_id",
        "time_s",
        {"latitude": DEGREES, "longitude": DEGREES, "absolute_altitude_m": METRES},
        {"relative_altitude_m": CLIMB},
    )
