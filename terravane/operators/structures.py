"""Objects on a surface: picking, crowns, bases, outlines, buildings, meshes, reference surfaces, spread samples.

Labelled cells are tables (survey_id, i, j, label, layers...), as ``neighbour.components`` gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators import grid as G
from terravane.operators import neighbour as N
from terravane.session import cut_lineage

CELL = G.CELL


def picked(clicks: DataFrame, labelled: DataFrame, res: float, reach_m: float) -> DataFrame:
    """(survey_id, pid, label, cells): the object whose cell centre is nearest to a click, if within reach."""
    centres = labelled.select("survey_id", (F.col("i") * (1 << 31) + F.col("j")).alias("pid"), ((F.col("j") + 0.5) * res).alias("x"), ((F.col("i") + 0.5) * res).alias("z"), "label")
    near = G.nearest(clicks, centres, reach_m, keep_self=True).select("survey_id", "pid", F.col("o_label").alias("label"))
    sizes = labelled.groupBy("survey_id", "label").agg(F.count("*").alias("cells"))
    return near.join(sizes, ["survey_id", "label"])


def crowns(cells: DataFrame, layer: str) -> DataFrame:
    """The cells with the local maximum (3 x 3, ties all count) they belong to: the nearest one, near_i and near_j."""
    # two separable passes need the whole box of cells: a diagonal neighbour is met through the one between
    around = G.box(G.dense(cells.select(*CELL, layer)), 1, __top=(layer, "max"))
    tops = around.where(F.col(layer) >= F.col("__top")).select(*CELL)
    return cells.join(N.nearest_cells(cells, tops).drop("d2"), CELL)


def base_ring(free: DataFrame, labelled: DataFrame, layer: str, d2: int, least: int = 3) -> DataFrame:
    """(survey_id, label, cells, base_m): median of the free cells around each object.

    A cell counts for the object nearest to it, within a squared distance in cells; objects with fewer than
    ``least`` such cells have no base.
    """
    near = N.nearest_cells(free, labelled).where(F.col("d2") <= d2)
    owner = labelled.select("survey_id", F.col("i").alias("near_i"), F.col("j").alias("near_j"), "label")
    ring = near.join(owner, ["survey_id", "near_i", "near_j"]).join(free, CELL)
    return ring.groupBy("survey_id", "label").agg(F.count("*").alias("cells"), F.percentile(layer, F.lit(0.5)).alias("base_m")).where(F.col("cells") >= least)


def open_edges(labelled: DataFrame) -> DataFrame:
    """Labelled cells with ``open``, the number of their four edges beyond which the object ends."""
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    own = labelled.select(*CELL, "label")
    moved = own.withColumn("o", F.explode(sides)).select("survey_id", "label", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"))
    met = moved.groupBy("survey_id", "label", "i", "j").agg(F.count("*").alias("k"))
    return own.join(met, ["survey_id", "label", "i", "j"], "left").withColumn("open", 4 - F.coalesce("k", F.lit(0))).drop("k")


def buildings(labelled: DataFrame, height: str, res: float, least_m2: float = 12.0, storey_m: float = 3.0) -> DataFrame:
    """(survey_id, label, area_m2, height_m, volume_m3, storeys, x, z) of objects of some area."""
    r = G.ranked(labelled, ["survey_id", "label"], height)
    o = r.groupBy("survey_id", "label").agg(
        (F.count("*") * res * res).alias("area_m2"), G.at_rank(height, 0.95).alias("height_m"), (F.sum(height) * res * res).alias("volume_m3"), ((F.avg("j") + 0.5) * res).alias("x"), ((F.avg("i") + 0.5) * res).alias("z")
    )
    storeys = F.greatest(F.lit(1), F.round(F.col("height_m") / storey_m)).cast("bigint")
    return o.where(F.col("area_m2") >= least_m2).withColumn("storeys", storeys)


def height_field_faces(cells: DataFrame, layer: str, res: float) -> DataFrame:
    """(survey_id, i, j, k, v, nx, nz): two triangles for each square of cells with a height.

    v are the three vertices (i, j); (nx, 1, nz) is the face's normal times twice its area over res squared.
    """
    own = cells.where(F.col(layer).isNotNull()).select(*CELL, F.col(layer).alias("z00"))
    for name, a, b in (("z01", 0, 1), ("z10", 1, 0), ("z11", 1, 1)):
        other = cells.where(F.col(layer).isNotNull()).select("survey_id", (F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.col(layer).alias(name))
        own = own.join(other, CELL)
    corner = lambda a, b: F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"))
    slope = lambda b, a: -(F.col(b) - F.col(a)) / res
    one = F.struct(F.lit(0).alias("k"), F.array(corner(0, 0), corner(1, 0), corner(0, 1)).alias("v"), slope("z01", "z00").alias("nx"), slope("z10", "z00").alias("nz"))
    two = F.struct(F.lit(1).alias("k"), F.array(corner(1, 0), corner(1, 1), corner(0, 1)).alias("v"), slope("z11", "z10").alias("nx"), slope("z11", "z01").alias("nz"))
    return own.select(*CELL, F.explode(F.array(one, two)).alias("f")).select(*CELL, "f.*")


def vertex_normals(faces: DataFrame) -> DataFrame:
    """(survey_id, i, j, nx, ny, nz): unit sums of the normals of the faces around each vertex."""
    each = faces.select("survey_id", F.explode("v").alias("p"), "nx", "nz").groupBy("survey_id", "p.i", "p.j").agg(F.sum("nx").alias("x"), F.count("*").cast("double").alias("y"), F.sum("nz").alias("z"))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return each.select(*CELL, (F.col("x") / size).alias("nx"), (F.col("y") / size).alias("ny"), (F.col("z") / size).alias("nz"))


def farthest_points(points: DataFrame, most: int, apart: float = 0.0) -> DataFrame:
    """(survey_id, pid, rank, gap): greedy sample of points, each farthest from all before it.

    The first is the one with the smallest pid, ties go to the smallest pid; a survey ends where the next
    gap would be at most ``apart``. Each choice is one aggregation over all points, which carry their distance
    to the sample so far; the sample is at most ``most`` rows a survey.
    """
    state = cut_lineage(points.select("survey_id", "pid", "x", "z").withColumn("gap", F.lit(float("inf"))))
    chosen = None
    for rank in range(most):
        best = state.where(F.col("gap") > apart).groupBy("survey_id").agg(F.max(F.struct("gap", (-F.col("pid")).alias("p"), "x", "z")).alias("m"))
        best = cut_lineage(best.select("survey_id", (-F.col("m.p")).alias("pid"), F.lit(rank).alias("rank"), F.col("m.gap").alias("gap"), F.col("m.x").alias("x0"), F.col("m.z").alias("z0")))
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best)
        away = F.hypot(F.col("x") - F.col("x0"), F.col("z") - F.col("z0"))
        state = cut_lineage(state.join(best.select("survey_id", "x0", "z0"), "survey_id").select("survey_id", "pid", "x", "z", F.least("gap", away).alias("gap")))
    if chosen is None:
        return points.select("survey_id", "pid").limit(0).withColumn("rank", F.lit(0)).withColumn("gap", F.lit(0.0))
    return chosen.select("survey_id", "pid", "rank", F.when(F.col("gap") == float("inf"), None).otherwise(F.col("gap")).alias("gap"))


def reference_surface(cells: DataFrame, layer: str, sigma: float, rounds: int = 4, k: float = 2.5) -> DataFrame:
    """The cells with ``reference``, a smoothed layer, and ``used``, whether they shaped it.

    Each round smooths the cells in use and leaves out those that lie more than k robust sigmas of their
    survey below the surface.
    """
    out = cells.withColumn("used", F.lit(True))
    for n in range(rounds):
        shaped = N.smooth(out.withColumn("__v", F.when(F.col("used"), F.col(layer))), "__v", sigma, "reference")
        off = F.col(layer) - F.col("reference")
        seen = shaped.withColumn("__off", off)
        if n + 1 == rounds:
            return seen.drop("__v", "__off")
        middle = G.quantile(seen, ["survey_id"], "__off", 0.5, "__mid").join(G.mad_sigma(seen, ["survey_id"], "__off"), "survey_id")
        low = F.coalesce(F.col("__off") <= F.col("__mid") - k * F.col("sigma"), F.lit(False))
        out = cut_lineage(seen.join(middle, "survey_id").select(*cells.columns, (~low).alias("used")))
    return out


def small_holes_filled(mask: DataFrame, raster: DataFrame, most: float) -> DataFrame:
    """(survey_id, i, j, filled): the mask and the enclosed holes of at most ``most`` cells."""
    gaps = N.components(raster.select(*CELL).join(mask, CELL, "left_anti"), corners=False)
    ends = raster.groupBy("survey_id").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    at_border = (F.col("i") == F.col("i0")) | (F.col("i") == F.col("i1")) | (F.col("j") == F.col("j0")) | (F.col("j") == F.col("j1"))
    sizes = gaps.join(ends, "survey_id").groupBy("survey_id", "label").agg(F.count("*").alias("n"), F.bool_or(at_border).alias("open"))
    small = sizes.where((F.col("n") <= most) & ~F.col("open")).select("survey_id", "label")
    return mask.select(*CELL, F.lit(False).alias("filled")).unionByName(gaps.join(small, ["survey_id", "label"]).select(*CELL, F.lit(True).alias("filled")))
