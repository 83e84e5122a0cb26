"""Georeference of camera tracks: levelled fits of every survey at once, the order test and what follows from them.

A levelled fit has four degrees of freedom: scale, turn about the vertical and a shift. It is closed in the
means and second moments of the pairs, so all surveys are fitted by one aggregation with map-side combine,
and no pair reaches the driver. Model axes are x east and z south; e and n are metres east and north.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.grid import quantile
from terravane.session import cut_lineage

EARTH_M = 6371000.0


def local_metres(pairs: DataFrame, keys: list[str], lat: str, lon: str) -> DataFrame:
    """Adds e and n, metres from the mean position of each group, and that position as lat0 and lon0."""
    middle = pairs.groupBy(*keys).agg(F.avg(lat).alias("lat0"), F.avg(lon).alias("lon0"))
    east = F.radians(F.col(lon) - F.col("lon0")) * F.cos(F.radians("lat0")) * EARTH_M
    return pairs.join(middle, keys).withColumn("e", east).withColumn("n", F.radians(F.col(lat) - F.col("lat0")) * EARTH_M)


def levelled_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs, a, b, mx, mz, me, mn, scale, turn_deg, rmse, spread) of pairs (x, z) and (e, n).

    Groups of fewer than three pairs, or whose model points fall together, have no fit.
    """
    s = -F.col("z")
    m = pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.avg("x").alias("mx"), F.avg("z").alias("mz"), F.avg("e").alias("me"), F.avg("n").alias("mn"),
        (F.var_pop("x") + F.var_pop("z")).alias("vs"), (F.var_pop("e") + F.var_pop("n")).alias("vt"),
        (F.covar_pop(F.col("x"), F.col("e")) + F.covar_pop(s, F.col("n"))).alias("p"), (F.covar_pop(F.col("x"), F.col("n")) - F.covar_pop(s, F.col("e"))).alias("q"),
    ).where("pairs >= 3 AND vs > 1e-9")
    m = m.withColumn("a", F.col("p") / F.col("vs")).withColumn("b", F.col("q") / F.col("vs"))
    rmse = F.sqrt(F.greatest(F.lit(0.0), F.col("vt") - (F.col("p") * F.col("p") + F.col("q") * F.col("q")) / F.col("vs")))
    return m.select(*keys, "pairs", "a", "b", "mx", "mz", "me", "mn", F.hypot("a", "b").alias("scale"), F.degrees(F.atan2("b", "a")).alias("turn_deg"), rmse.alias("rmse"), F.sqrt("vt").alias("spread"))


def fitted(x: str = "x", z: str = "z") -> tuple[Column, Column]:
    """East and north of a model position under the columns of ``levelled_fit``."""
    dx, ds = F.col(x) - F.col("mx"), F.col("mz") - F.col(z)
    return F.col("me") + F.col("a") * dx - F.col("b") * ds, F.col("mn") + F.col("b") * dx + F.col("a") * ds


def trimmed_levelled_fit(pairs: DataFrame, keys: list[str], floor_m: float = 3.75, factor: float = 3.0, rounds: int = 2) -> DataFrame:
    """``levelled_fit`` of the pairs that lie within max(floor, factor * median miss) of the fit before."""
    fit = cut_lineage(levelled_fit(pairs, keys))
    for _ in range(rounds):
        e, n = fitted()
        missed = cut_lineage(pairs.join(fit, keys).select(*pairs.columns, F.hypot(F.col("e") - e, F.col("n") - n).alias("miss")))
        limit = quantile(missed, keys, "miss", 0.5, "middle")
        kept = missed.join(limit, keys).where(F.col("miss") <= F.greatest(F.lit(floor_m), factor * F.col("middle")))
        fit = cut_lineage(levelled_fit(kept.select(*pairs.columns), keys))
    return fit


def both_orders(pairs: DataFrame) -> DataFrame:
    """The pairs (survey_id, x, z, lat, lon) as stored and with the coordinates swapped, where that gives positions."""
    swapped = pairs.withColumn("swapped", F.lit(True)).withColumn("first", F.col("lon")).withColumn("second", F.col("lat"))
    stored = pairs.withColumn("swapped", F.lit(False)).withColumn("first", F.col("lat")).withColumn("second", F.col("lon"))
    both = stored.unionByName(swapped).drop("lat", "lon").withColumnsRenamed({"first": "lat", "second": "lon"})
    return both.where((F.abs("lat") <= 90) & (F.abs("lon") <= 180) & ~((F.abs("lat") < 1e-9) & (F.abs("lon") < 1e-9)))


def order_fits(pairs: DataFrame) -> DataFrame:
    """Fits of both coordinate orders: the columns of ``levelled_fit`` by (survey_id, swapped), with lat0 and lon0."""
    keys = ["survey_id", "swapped"]
    placed = cut_lineage(local_metres(both_orders(pairs), keys, "lat", "lon"))
    origin = placed.groupBy(*keys).agg(F.min("lat0").alias("lat0"), F.min("lon0").alias("lon0"))
    return trimmed_levelled_fit(placed.select(*keys, "x", "z", "e", "n"), keys).join(origin, keys)


def chosen_order(fits: DataFrame, better: float = 0.6) -> DataFrame:
    """(survey_id, rmse, rmse_swapped, swapped): swapped where that fits clearly better, or is the only fit."""
    rmse = lambda flag: F.max(F.when(F.col("swapped") == F.lit(flag), F.col("rmse")))
    two = fits.groupBy("survey_id").agg(rmse(False).alias("rmse"), rmse(True).alias("rmse_swapped"))
    return two.withColumn("swapped", F.coalesce(F.col("rmse_swapped") < better * F.col("rmse"), F.col("rmse").isNull()))


def solved(fits: DataFrame) -> DataFrame:
    """The fit of each survey in its chosen order, with scale uncertainty and confidence."""
    one = fits.join(chosen_order(fits).select("survey_id", "swapped"), ["survey_id", "swapped"])
    doubt = F.col("rmse") / F.greatest(F.lit(1e-6), F.col("spread") * F.sqrt(F.least(F.col("pairs"), F.lit(10)).cast("double")))
    grade = F.when(doubt < 0.01, "HIGH").when(doubt < 0.05, "MEDIUM").otherwise("LOW")
    return one.withColumn("scale_doubt", doubt).withColumn("confidence", grade)


def geodetic(e: Column, n: Column) -> tuple[Column, Column]:
    """Latitude and longitude of metres from lat0 and lon0."""
    return F.col("lat0") + F.degrees(n / EARTH_M), F.col("lon0") + F.degrees(e / (EARTH_M * F.cos(F.radians("lat0"))))


def pair_scales(poses: DataFrame, key: str, steps: tuple[int, ...], least_m: float) -> DataFrame:
    """(survey_id, n, ratio): median of metric over model distance of poses some keyframes apart.

    Both ends must be at least ``least_m`` apart in the model. Pairs come from equi-joins, one for each step.
    """
    own = poses.select("survey_id", key, "x", "z", "e", "n")
    out = None
    for step in steps:
        other = own.select("survey_id", (F.col(key) - step).alias(key), *[F.col(c).alias(f"{c}1") for c in ("x", "z", "e", "n")])
        far = own.join(other, ["survey_id", key]).withColumn("m", F.hypot(F.col("x") - F.col("x1"), F.col("z") - F.col("z1"))).where(F.col("m") >= least_m)
        far = far.select("survey_id", (F.hypot(F.col("e") - F.col("e1"), F.col("n") - F.col("n1")) / F.col("m")).alias("r"))
        out = far if out is None else out.unionByName(far)
    return out.groupBy("survey_id").agg(F.count("*").alias("n")).join(quantile(out, ["survey_id"], "r", 0.5, "ratio"), "survey_id")


def control_corrected(residuals: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Residuals after the origin is moved by their mean, which is kept as shift_* so that it can be undone."""
    means = residuals.groupBy(*keys).agg(*[F.avg(c).alias(f"shift_{c}") for c in columns])
    out = residuals.join(means, keys)
    return out.withColumns({c: F.col(c) - F.col(f"shift_{c}") for c in columns})


def scaled_intrinsics(cameras: DataFrame, width: int, height: int, tolerance: float = 0.01) -> DataFrame:
    """fx, fy, cx, cy of (width, height, fx, fy, cx, cy) rows for another image size; null where the aspect differs."""
    sx, sy = F.lit(float(width)) / F.col("width"), F.lit(float(height)) / F.col("height")
    same = F.abs(sx / sy - 1) <= tolerance
    scaled = {"fx": sx, "cx": sx, "fy": sy, "cy": sy}
    return cameras.withColumns({c: F.when(same, F.col(c) * by) for c, by in scaled.items()} | {"width": F.lit(width), "height": F.lit(height), "fits": same})
