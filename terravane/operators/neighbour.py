"""Neighbourhoods, morphology, components, sight and ways on rasters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators import kernels as K
from terravane.operators.grid import CELL, box, dense
from terravane.session import cut_lineage


def offsets(r: float, square: bool = False, weight=None) -> Column:  # noqa: ANN001
    """Array of (di, dj, d2, w) of a disk or square of radius r around a cell."""
    k = math.ceil(r)
    pairs = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if square or a * a + b * b <= r * r + 1e-9]
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(a * a + b * b).alias("d2"), F.lit(float(weight(a, b)) if weight else 1.0).alias("w")) for a, b in pairs])


def spread(cells: DataFrame, around: Column, *keep: str) -> DataFrame:
    """Each cell repeated at its offsets, with d2, w and the columns of its origin as oi, oj."""
    out = cells.withColumn("o", F.explode(around))
    return out.select("survey_id", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), F.col("i").alias("oi"), F.col("j").alias("oj"), F.col("o.d2").alias("d2"), F.col("o.w").alias("w"), *keep)


def dilate(mask: DataFrame, r: float, square: bool = False) -> DataFrame:
    """Cells within r of a cell of the mask."""
    return spread(mask, offsets(r, square)).select(*CELL).distinct()


def erode(mask: DataFrame, r: float, square: bool = False) -> DataFrame:
    """Cells of the mask all of whose neighbours within r are in it."""
    around = offsets(r, square)
    whole = spread(mask, around).groupBy(*CELL).agg(F.count("*").alias("k"))
    return whole.where(F.col("k") == F.size(around)).select(*CELL).join(mask, CELL, "left_semi")


def open_mask(mask: DataFrame, r: float, square: bool = True) -> DataFrame:
    return dilate(erode(mask, r, square), r, square)


def close_mask(mask: DataFrame, r: float, square: bool = True) -> DataFrame:
    return erode(dilate(mask, r, square), r, square).unionByName(mask.select(*CELL)).distinct()


def nearest_cells(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """(survey_id, i, j, d2, near_i, near_j): the nearest mask cell of each cell, however far; of ties the smallest.

    Exact and in two passes: the nearest mask cell along each column, by windows over the column, then the
    best of those along each row, where only columns within the distance known so far are compared. A
    task holds lines of a raster. Surveys without a mask cell give no rows.
    """
    grid = dense(cells.select(*CELL).withColumn("asked", F.lit(True)).unionByName(mask.select(*CELL).withColumn("asked", F.lit(None).cast("boolean"))).groupBy(*CELL).agg(F.max("asked").alias("asked")))
    grid = grid.join(mask.select(*CELL).distinct().withColumn("m", F.col("i")), CELL, "left")
    column = Window.partitionBy("survey_id", "j")
    up = F.last("m", ignorenulls=True).over(column.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    down = F.last("m", ignorenulls=True).over(column.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    near = grid.select(*CELL, "asked", up.alias("up"), down.alias("down"))
    best = F.when(F.col("down").isNull() | (F.col("i") - F.col("up") <= F.col("down") - F.col("i")), F.col("up")).otherwise(F.col("down"))
    near = near.select(*CELL, "asked", best.cast("double").alias("n"))

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        i, j, n = float(pdf["i"].iloc[0]), pdf["j"].to_numpy().astype(float), pdf["n"].to_numpy(dtype=float)
        own = np.where(np.isnan(n), np.inf, (n - i) ** 2)
        d2, ni, nj = own.copy(), n.copy(), np.where(np.isnan(n), np.nan, j)
        for off in range(1, len(j)):
            if off * off > d2.max():
                break
            for a, b in ((slice(off, None), slice(None, -off)), (slice(None, -off), slice(off, None))):
                new = own[b] + off * off
                better = (new < d2[a]) | (new == d2[a]) & np.isfinite(new) & ((n[b] < ni[a]) | (n[b] == ni[a]) & (j[b] < nj[a]))
                for out, value in ((d2, new), (ni, n[b]), (nj, j[b])):
                    out[a] = np.where(better, value, out[a])
        keep = (pdf["asked"] == True).to_numpy() & np.isfinite(d2)  # noqa: E712
        return pd.DataFrame({"survey_id": pdf["survey_id"][keep], "i": pdf["i"][keep], "j": pdf["j"][keep], "d2": d2[keep].astype(np.int64), "near_i": ni[keep].astype(np.int64), "near_j": nj[keep].astype(np.int64)})

    return near.groupBy("survey_id", "i").applyInPandas(along, "survey_id string, i bigint, j bigint, d2 bigint, near_i bigint, near_j bigint")


def distance_to(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Distance in cells to the nearest mask cell, and which cell that is; null where a survey has none."""
    near = nearest_cells(cells, mask).withColumn("distance", F.sqrt(F.col("d2").cast("double")))
    return cells.join(near.drop("d2"), CELL, "left")


def nearest_fill(raster: DataFrame, layer: str, name: str, r: float | None = None) -> DataFrame:
    """Missing values from the nearest cell with a value, within r cells where r is given."""
    known = raster.where(F.col(layer).isNotNull())
    near = nearest_cells(raster.where(F.col(layer).isNull()), known)
    near = near if r is None else near.where(F.col("d2") <= r * r)
    values = known.select("survey_id", F.col("i").alias("near_i"), F.col("j").alias("near_j"), F.col(layer).alias("__near"))
    found = near.join(values, ["survey_id", "near_i", "near_j"]).select(*CELL, "__near")
    return raster.join(found, CELL, "left").withColumn(name, F.coalesce(F.col(layer), F.col("__near"))).drop("__near")


def smooth(raster: DataFrame, layer: str, sigma: float, name: str) -> DataFrame:
    """Normalised Gaussian mean of the cells with a value, out to three sigma."""
    around = offsets(3 * sigma, weight=lambda a, b: math.exp(-(a * a + b * b) / (2 * sigma * sigma)))
    near = spread(raster.where(F.col(layer).isNotNull()), around, layer).groupBy(*CELL).agg((F.sum(F.col("w") * F.col(layer)) / F.sum("w")).alias(name))
    return raster.join(near, CELL, "left")


def components(mask: DataFrame, tile: int = 256, corners: bool = True) -> DataFrame:
    """Components: (survey_id, i, j, label); a label is the code of its smallest cell. Cells meet at corners, or at edges only.

    Tiles are labelled by themselves. What remains is the graph of labels that touch across tile borders,
    whose size is that of the borders; it is merged by rounds of neighbour minimum and pointer jumping,
    each checkpointed, until nothing changes.
    """
    code = lambda i, j: i * (1 << 31) + j
    cells = mask.select(*CELL).distinct().withColumns({"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)})

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        grid = np.zeros((int(i.max() - i.min()) + 1, int(j.max() - j.min()) + 1), dtype=bool)
        grid[i - i.min(), j - j.min()] = True
        number = K.label(grid, corners)[i - i.min(), j - j.min()]
        own = code(i.astype(np.int64), j.astype(np.int64))
        least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number, own)
        return pd.DataFrame({"survey_id": pdf["survey_id"], "i": i, "j": j, "label": least[number]})

    # the labels of the tiles are used three times and come from costly plans as a rule
    local = cut_lineage(cells.groupBy("survey_id", "ti", "tj").applyInPandas(work, "survey_id string, i bigint, j bigint, label bigint"))
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = local.where(edge("i") | edge("j"))
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in (((0, 1), (1, -1), (1, 0), (1, 1)) if corners else ((0, 1), (1, 0)))])
    moved = border.withColumn("o", F.explode(around)).select("survey_id", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), F.col("label").alias("other"))
    edges = border.join(moved, CELL).where("label <> other").select("survey_id", F.col("label").alias("a"), F.col("other").alias("b")).distinct()
    merged = merge_labels(edges)
    if merged is None:
        return local
    return local.join(merged, ["survey_id", "label"], "left").select(*CELL, F.coalesce("root", "label").alias("label"))


def merge_labels(edges: DataFrame) -> DataFrame | None:
    """(survey_id, label, root): the smallest label each one is connected with; None without edges."""
    both = cut_lineage(edges.select("survey_id", "a", "b").unionByName(edges.select("survey_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return None
    roots = both.select("survey_id", F.col("a").alias("label")).distinct().withColumn("root", F.col("label"))
    while True:
        of_b = roots.select("survey_id", F.col("label").alias("b"), F.col("root").alias("near"))
        least = both.join(of_b, ["survey_id", "b"]).groupBy("survey_id", F.col("a").alias("label")).agg(F.min("near").alias("near"))
        hooked = roots.join(least, ["survey_id", "label"]).select("survey_id", "label", "root", F.least("root", "near").alias("next"))
        jump = hooked.select("survey_id", F.col("label").alias("next"), F.col("next").alias("far"))
        stepped = cut_lineage(hooked.join(jump, ["survey_id", "next"], "left").select("survey_id", "label", F.least("next", F.coalesce("far", "next")).alias("new"), "root"))
        changed = stepped.where("new <> root").limit(1).count()
        roots = stepped.select("survey_id", "label", F.col("new").alias("root"))
        if not changed:
            break
    return roots


def grow(strong: DataFrame, weak: DataFrame, tile: int = 256) -> DataFrame:
    """Cells of the weak mask whose component holds a strong cell."""
    labelled = components(weak.select(*CELL).unionByName(strong.select(*CELL)), tile)
    seeds = labelled.join(strong.select(*CELL), CELL, "left_semi").select("survey_id", "label").distinct()
    return labelled.join(seeds, ["survey_id", "label"], "left_semi").select(*CELL)


def fill_holes(mask: DataFrame, raster: DataFrame, tile: int = 256) -> DataFrame:
    """The mask with the parts of its complement that do not touch the border of the raster.

    The complement is joined by edges only, as the mask is by corners too.
    """
    outside = components(raster.select(*CELL).join(mask, CELL, "left_anti"), tile, corners=False)
    limits = raster.groupBy("survey_id").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    at_border = (F.col("i") == F.col("i0")) | (F.col("i") == F.col("i1")) | (F.col("j") == F.col("j0")) | (F.col("j") == F.col("j1"))
    open_ = outside.join(limits, "survey_id").where(at_border).select("survey_id", "label").distinct()
    holes = outside.join(open_, ["survey_id", "label"], "left_anti").select(*CELL)
    return mask.select(*CELL).unionByName(holes).distinct()


def ray_count(radius: float, res: float) -> int:
    """Rays that leave no gap at the rim, within the bounds of 360 and 2048."""
    return int(min(2048, max(360, math.ceil(2 * math.pi * radius / res))))


def viewshed(raster: DataFrame, ground: str, observers: DataFrame, res: float, radius: float, rays: int | None = None, target: float = 1.7) -> DataFrame:
    """Cells an observer sees: (survey_id, observer, i, j, distance of the cell's centre).

    observers: survey_id, observer, x, z, eye (absolute height). Rays go out in steps of a cell, as far as
    the radius and the raster reach; a cell is seen where the elevation angle of its target is at least the
    largest ground angle before it. Small gaps between seen cells are closed (3 x 3).
    """
    rays = rays or ray_count(radius, res)
    extent = raster.groupBy("survey_id").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    far = F.hypot(F.greatest(F.abs(F.col("z") - F.col("i0") * res), F.abs((F.col("i1") + 1) * res - F.col("z"))), F.greatest(F.abs(F.col("x") - F.col("j0") * res), F.abs((F.col("j1") + 1) * res - F.col("x"))))
    steps = F.ceil(F.least(F.lit(float(radius)), far) / res).cast("int")
    fan = observers.join(extent, "survey_id").withColumn("steps", F.least(F.lit(int(radius / res)), steps)).where("steps >= 1")
    fan = fan.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    angle = (F.col("ray") + 0.5) * (2 * math.pi / rays)
    fan = fan.withColumn("d", F.col("step") * res)
    fan = fan.withColumn("i", F.floor((F.col("z") + F.sin(angle) * F.col("d")) / res)).withColumn("j", F.floor((F.col("x") + F.cos(angle) * F.col("d")) / res))
    fan = fan.where("i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1")
    cells = raster.where(F.col(ground).isNotNull()).select(*CELL, F.col(ground).alias("g"))
    seen = fan.join(cells, CELL)
    seen = seen.withColumn("slope_g", (F.col("g") - F.col("eye")) / F.col("d")).withColumn("slope_t", (F.col("g") + target - F.col("eye")) / F.col("d"))
    before = Window.partitionBy("survey_id", "observer", "ray").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    clear = F.col("slope_t") >= F.coalesce(F.max("slope_g").over(before), F.lit(-1e9))
    visible = cut_lineage(seen.withColumn("clear", clear).where("clear").select("survey_id", "observer", "i", "j").distinct())
    keyed = visible.select(F.concat_ws("\0", "survey_id", F.col("observer").cast("string")).alias("survey_id"), "i", "j")
    closed = close_mask(keyed, 1).withColumn("parts", F.split("survey_id", "\0")).select(F.col("parts")[0].alias("survey_id"), F.col("parts")[1].cast("bigint").alias("observer"), "i", "j")
    closed = closed.join(cells.select(*CELL), CELL, "left_semi").join(observers.select("survey_id", "observer", "x", "z"), ["survey_id", "observer"])
    away = F.sqrt(F.pow((F.col("j") + 0.5) * res - F.col("x"), 2) + F.pow((F.col("i") + 0.5) * res - F.col("z"), 2))
    return closed.select("survey_id", "observer", "i", "j", away.alias("distance"))


def enclosure(sites: DataFrame, cover: DataFrame, near: int, far: int, rays: int = 36) -> DataFrame:
    """(survey_id, i, j, enclosure, q1..q4, first): share of rays, in all and by quadrant, that meet cover.

    Rays go from ``near`` to ``far`` cells; ``first`` is the mean number of cells to the first cover.
    """
    fan = sites.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1)))).withColumn("step", F.explode(F.sequence(F.lit(near), F.lit(far))))
    angle = (F.col("ray") + 0.5) * (2 * math.pi / rays)
    fan = fan.withColumn("ti", F.floor(F.col("i") + 0.5 + F.sin(angle) * F.col("step"))).withColumn("tj", F.floor(F.col("j") + 0.5 + F.cos(angle) * F.col("step")))
    met = fan.join(cover.select("survey_id", F.col("i").alias("ti"), F.col("j").alias("tj")), ["survey_id", "ti", "tj"]).groupBy(*CELL, "ray").agg(F.min("step").alias("first"))
    part = rays / 4
    quarters = [(F.count_if((F.col("ray") >= k * part) & (F.col("ray") < (k + 1) * part)) / part).alias(f"q{k + 1}") for k in range(4)]
    return sites.select(*CELL).join(met, CELL, "left").groupBy(*CELL).agg((F.count("ray") / float(rays)).alias("enclosure"), *quarters, F.avg("first").alias("first"))


def exposure(seen: DataFrame, p0: float = 0.95, half_m: float = 350.0) -> DataFrame:
    """Chance that at least one observer notices a target in a cell; p0 < 1 keeps the logarithm finite."""
    p = p0 * F.pow(F.lit(2.0), -F.pow(F.col("distance") / half_m, 2))
    return seen.groupBy(*CELL).agg((1 - F.exp(F.sum(F.log(1 - p)))).alias("exposure"), F.count("*").alias("observers"))


def tile_kernel(raster: DataFrame, layers: list[str], tile: int, halo: int, kernel, schema: str) -> DataFrame:  # noqa: ANN001
    """Runs ``kernel(arrays, present, i0, j0)`` on tiles with a halo; it returns arrays by name.

    Cells near a tile edge are repeated into the neighbours; each result cell comes from its home tile.
    """
    t = lambda c, k: F.floor((F.col(c) + k) / tile)
    base = raster.withColumn("ti", F.explode(F.sequence(t("i", -halo), t("i", halo)))).withColumn("tj", F.explode(F.sequence(t("j", -halo), t("j", halo))))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        i0, j0 = int(i.min()), int(j.min())
        shape = (int(i.max()) - i0 + 1, int(j.max()) - j0 + 1)
        present = np.zeros(shape, dtype=bool)
        present[i - i0, j - j0] = True
        arrays = {}
        for name in layers:
            a = np.full(shape, np.nan)
            a[i - i0, j - j0] = pdf[name].to_numpy(dtype=float)
            arrays[name] = a
        out = kernel(arrays, present, i0, j0)
        home = (i // tile == pdf["ti"].iloc[0]) & (j // tile == pdf["tj"].iloc[0])
        result = {"survey_id": pdf["survey_id"][home], "i": i[home], "j": j[home]}
        result |= {k: v[i[home] - i0, j[home] - j0] for k, v in out.items()}
        return pd.DataFrame(result)

    return base.groupBy("survey_id", "ti", "tj").applyInPandas(work, schema)


def bare_earth(raster: DataFrame, tile: int = 256, halo: int = 48, rounds: int = 200) -> DataFrame:
    """(survey_id, i, j, dtm): ground cells as they are, the others by harmonic filling between them."""
    known = raster.withColumn("ground", F.when(~F.col("object"), F.col("zlo")))

    def kernel(a: dict, present: np.ndarray, i0: int, j0: int) -> dict:
        return {"dtm": K.harmonic(a["ground"], ~np.isnan(a["ground"]), rounds)}

    return tile_kernel(known.select(*CELL, "ground"), ["ground"], tile, halo, kernel, "survey_id string, i bigint, j bigint, dtm double")


def max_within(raster: DataFrame, layer: str, r: int, name: str) -> DataFrame:
    return box(raster, r, **{name: (layer, "max")})
