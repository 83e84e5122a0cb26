"""Fits whose sums Spark makes and whose last step is a few numbers on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators import kernels as K
from terravane.operators.grid import quantile


def similarity_fit(pairs: DataFrame, source: list[str], target: list[str], scaled: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation, shift that take the source columns to the target ones.

    One aggregation of means and cross moments; the decomposition is of a 3 x 3 (or 2 x 2) matrix.
    """
    means = [F.avg(c).alias(f"m_{c}") for c in (*source, *target)]
    cross = [F.covar_pop(t, s).alias(f"c_{i}_{j}") for i, t in enumerate(target) for j, s in enumerate(source)]
    spread = [F.var_pop(s).alias(f"v_{s}") for s in source]
    row = pairs.agg(*means, *cross, *spread).first()
    mean_a, mean_b = (np.array([row[f"m_{c}"] for c in side]) for side in (source, target))
    matrix = np.array([[row[f"c_{i}_{j}"] for j in range(len(source))] for i in range(len(target))])
    return K.similarity_from_moments(mean_a, mean_b, matrix, sum(row[f"v_{s}"] for s in source), scaled)


def apply_fit(df: DataFrame, source: list[str], fit: tuple[float, np.ndarray, np.ndarray], names: list[str]) -> DataFrame:
    """The fitted positions as new columns; plain arithmetic on literals."""
    scale, rotation, shift = fit
    for i, name in enumerate(names):
        total: Column = F.lit(float(shift[i]))
        for j, s in enumerate(source):
            total = total + float(scale * rotation[i][j]) * F.col(s)
        df = df.withColumn(name, total)
    return df


def trimmed_fit(pairs: DataFrame, source: list[str], target: list[str], floor_m: float = 3.75, factor: float = 3.0, rounds: int = 8) -> tuple[tuple, int]:
    """Fit without outliers: pairs further than max(floor, factor * median) go, until none does.

    Every round is two aggregations over the pairs; nothing but the moments reaches the driver.
    """
    fit, kept, n = similarity_fit(pairs, source, target), pairs, -1
    for _ in range(rounds):
        moved = apply_fit(pairs, source, fit, [f"__f{i}" for i in range(len(target))])
        miss = F.sqrt(sum((F.pow(F.col(f"__f{i}") - F.col(t), 2) for i, t in enumerate(target)), F.lit(0.0)))
        moved = moved.withColumn("__miss", miss)
        middle = quantile(moved.withColumn("__all", F.lit(1)), ["__all"], "__miss", 0.5, "m").first()
        limit = max(floor_m, factor * (middle["m"] if middle else 0.0))
        kept = moved.where(F.col("__miss") <= limit)
        count = kept.count()
        if count == n or count < 3:
            break
        n, fit = count, similarity_fit(kept, source, target)
    return fit, n


def ground_mode(heights: DataFrame, column: str, tolerance: float = 0.01, bins: int = 512) -> float | None:
    """Level of the ground among heights: the half-sample mode of their lower half.

    The shortest interval that holds half of the values is taken again and again, until it is shorter
    than the tolerance. Each round is one aggregation to at most ``bins`` counts over the current
    interval, so stray values far below or above cost a round more and bias nothing. Nulls and NaN are no
    heights; None without any.
    """
    values = heights.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("h"))
    low, high = values.agg(F.min("h"), F.percentile_approx("h", 0.5, 10_000)).first()
    if low is None:
        return None
    while high - low > tolerance:
        width = (high - low) / bins
        place = F.least(F.floor((F.col("h") - low) / width), F.lit(bins - 1)).alias("k")
        counts = np.zeros(bins)
        for k, n in values.where(F.col("h").between(low, high)).groupBy(place).count().collect():  # at most ``bins`` rows
            counts[k] = n
        total = np.concatenate([[0.0], np.cumsum(counts)])
        end = np.searchsorted(total, total[:-1] + 0.5 * total[-1] - 1e-9)
        end = np.where(end <= bins, end, 10 * bins)
        length = end - np.arange(bins)
        first = int(length.argmin())
        ties = np.flatnonzero(length == length[first])
        first = int(ties[np.argmax([total[end[t]] - total[t] for t in ties])])
        if length[first] >= bins:
            break
        low, high = low + first * width, low + end[first] * width
    return (low + high) / 2
