"""Rasters as tables: cells of points, quantiles by floor rank, window filters, sampling, colours.

A raster is a table (survey_id, i, j, layers...): row i runs along +z, column j along +x, the centre of
cell (i, j) is ((j + 0.5) * res, (i + 0.5) * res). Filters are separable: one window along rows, one
along columns, so a window holds one line of a raster and never a survey.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.session import cut_lineage

CELL = ["survey_id", "i", "j"]


def with_cell(points: DataFrame, res: float) -> DataFrame:
    """Adds the cell of each point."""
    return points.withColumn("i", F.floor(F.col("z") / res)).withColumn("j", F.floor(F.col("x") / res))


def inside(points: DataFrame, x0: float, x1: float, z0: float, z1: float) -> DataFrame:
    """Points of a closed rectangle."""
    return points.where(F.col("x").between(x0, x1) & F.col("z").between(z0, z1))


def ranked(points: DataFrame, keys: list[str], value: str, ties: list[str] | None = None) -> DataFrame:
    """Adds the rank ``rk`` from 0 and the size ``n`` of each group, in the order of a value."""
    group = Window.partitionBy(*keys)
    return points.withColumn("rk", F.row_number().over(group.orderBy(value, *(ties or []))) - 1).withColumn("n", F.count("*").over(group))


def at_rank(value: Column | str, q: float, rank: str = "rk", n: str = "n") -> Column:
    """The element at floor(q * (n - 1)) of a ranked group, as an aggregate."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max(F.when(F.col(rank) == F.floor(F.lit(float(q)) * (F.col(n) - 1)), value))


def cells(points: DataFrame, res: float) -> DataFrame:
    """Counts, floor-rank quantiles of height and the mean colour of the upper half of each cell.

    One exchange: the ranks, and the aggregates over the same keys.
    """
    r = ranked(with_cell(points, res), CELL, "y", ["r", "g", "b"])
    upper = F.col("rk") >= F.floor(F.col("n") / 2)
    colours = [F.avg(F.when(upper, F.col(c))).alias(c) for c in "rgb"]
    return r.groupBy(*CELL).agg(
        F.count("*").alias("n"), at_rank("y", 0.10).alias("zlo"), at_rank("y", 0.50).alias("zmed"), at_rank("y", 0.95).alias("zhi"), F.max("y").alias("zmax"), *colours
    )


def dense(raster: DataFrame) -> DataFrame:
    """All cells of each survey's bounding box; the layers of cells without points are null."""
    box = raster.groupBy("survey_id").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    rows = box.withColumn("i", F.explode(F.sequence("i0", "i1")))
    full = rows.select("survey_id", "i", F.explode(F.sequence("j0", "j1")).alias("j"))
    return full.join(raster, CELL, "left")


def along_row(r: int) -> Window:
    return Window.partitionBy("survey_id", "i").orderBy("j").rangeBetween(-r, r)


def along_column(r: int) -> Window:
    return Window.partitionBy("survey_id", "j").orderBy("i").rangeBetween(-r, r)


def box(raster: DataFrame, r: int, **layers: tuple[str, str]) -> DataFrame:
    """Filters over squares of ``2r + 1`` cells of a dense raster: name=(layer, "sum" | "min" | "max").

    Nulls take no part, cells beyond the raster neither.
    """
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    out = raster
    for name, (layer, kind) in layers.items():
        out = out.withColumn(f"__{name}", how[kind](layer).over(along_row(r)))
    for name, (_, kind) in layers.items():
        out = out.withColumn(name, how[kind](f"__{name}").over(along_column(r)))
    return out.drop(*[f"__{name}" for name in layers])


def box_mean(raster: DataFrame, layer: str, r: int, name: str) -> DataFrame:
    """Mean over a square of the cells that have a value."""
    counted = raster.withColumn("__one", F.when(F.col(layer).isNotNull(), 1))
    out = box(counted, r, __s=(layer, "sum"), __n=("__one", "sum"))
    return out.withColumn(name, F.col("__s") / F.col("__n")).drop("__s", "__n", "__one")


def opening(raster: DataFrame, layer: str, r: int, name: str) -> DataFrame:
    """Grey opening: erosion, then dilation, by a square."""
    return box(box(raster, r, __low=(layer, "min")), r, **{name: ("__low", "max")}).drop("__low")


def slope_degrees(raster: DataFrame, layer: str, res: float, name: str = "slope") -> DataFrame:
    """Steepness from central differences, one-sided at the edges of the raster or of gaps."""
    out = raster
    parts = []
    for axis, window in (("x", Window.partitionBy("survey_id", "i").orderBy("j")), ("z", Window.partitionBy("survey_id", "j").orderBy("i"))):
        out = out.withColumn(f"__a{axis}", F.lag(layer).over(window)).withColumn(f"__b{axis}", F.lead(layer).over(window))
        a, b, c = F.col(f"__a{axis}"), F.col(f"__b{axis}"), F.col(layer)
        parts.append(F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * res)).when(b.isNotNull(), (b - c) / res).when(a.isNotNull(), (c - a) / res).otherwise(0.0))
    steep = F.degrees(F.atan(F.sqrt(parts[0] * parts[0] + parts[1] * parts[1])))
    return out.withColumn(name, F.when(F.col(layer).isNotNull(), steep)).drop("__ax", "__bx", "__az", "__bz")


def plane_rms(raster: DataFrame, layer: str, r: int = 2, name: str = "rough") -> DataFrame:
    """Residual of the least-squares plane of each square, from moments; null below six cells.

    Moments are taken about the raster's own corner and its layer's mean, so that far coordinates lose no digits.
    """
    w = F.when(F.col(layer).isNotNull(), 1.0)
    corner = raster.groupBy("survey_id").agg(F.min("i").alias("__i0"), F.min("j").alias("__j0"), F.avg(layer).alias("__l0"))
    base = raster.join(corner, "survey_id").withColumn("__w", w)
    value = F.col(layer) - F.col("__l0")
    i, j = (F.col("i") - F.col("__i0")).cast("double"), (F.col("j") - F.col("__j0")).cast("double")
    moments = {"w": F.col("__w"), "z": value, "zz": value * value, "i": w * i, "j": w * j, "ii": w * i * i, "jj": w * j * j, "ij": w * i * j, "iz": value * i, "jz": value * j}
    for k, expression in moments.items():
        base = base.withColumn(f"__m{k}", expression)
    out = box(base, r, **{f"__s{k}": (f"__m{k}", "sum") for k in moments})
    s = {k: F.col(f"__s{k}") for k in moments}
    n = s["w"]
    cov = lambda a, b, ab: s[ab] - s[a] * s[b] / n
    cii, cjj, cij, ciz, cjz, czz = cov("i", "i", "ii"), cov("j", "j", "jj"), cov("i", "j", "ij"), cov("i", "z", "iz"), cov("j", "z", "jz"), cov("z", "z", "zz")
    det = cii * cjj - cij * cij
    bi, bj = (ciz * cjj - cjz * cij) / F.nullif(det, F.lit(0.0)), (cjz * cii - ciz * cij) / F.nullif(det, F.lit(0.0))
    rss = F.greatest(F.lit(0.0), czz - bi * ciz - bj * cjz)
    rms = F.when((n >= 6) & (F.abs(det) > 1e-9), F.sqrt(rss / (n - 3)))
    return out.withColumn(name, rms).drop("__w", "__i0", "__j0", "__l0", *[f"__m{k}" for k in moments], *[f"__s{k}" for k in moments])


def colour_indices(raster: DataFrame) -> DataFrame:
    """Excess green, saturation and value of the mean colour."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return (
        raster.withColumn("exg", (2 * g - r - b) / (r + g + b + 1e-6))
        .withColumn("sat", F.when(top > 0, (top - low) / F.greatest(top, F.lit(1e-6))).otherwise(0.0))
        .withColumn("val", top / 255.0)
    )


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees by sextants; 0 for grey."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(d == 0, 0.0).otherwise(F.pmod(h * 60.0, F.lit(360.0)))


def sample_bilinear(points: DataFrame, raster: DataFrame, layer: str, res: float, name: str) -> DataFrame:
    """Layer at each point between the four nearest cell centres, the nearest edge beyond the raster.

    Corners are joined by cell: points carry four corner keys, clamped to the survey's box, whose one
    row for each survey is joined first. A corner without value leaves the mean of the others by weight.
    """
    extent = raster.groupBy("survey_id").agg(F.min("i").alias("__i0"), F.max("i").alias("__i1"), F.min("j").alias("__j0"), F.max("j").alias("__j1"))
    p = points.join(extent, "survey_id")
    fi = F.greatest(F.col("__i0").cast("double"), F.least(F.col("__i1").cast("double"), F.col("z") / res - 0.5))
    fj = F.greatest(F.col("__j0").cast("double"), F.least(F.col("__j1").cast("double"), F.col("x") / res - 0.5))
    p = p.withColumn("__fi", fi).withColumn("__fj", fj).withColumn("__ci", F.floor("__fi")).withColumn("__cj", F.floor("__fj"))
    corners = raster.select("survey_id", F.col("i").alias("__ci"), F.col("j").alias("__cj"), F.col(layer).alias("__z"))
    # the raster carries its right and lower neighbours, so each point needs one equi-join only
    row = Window.partitionBy("survey_id", "__ci").orderBy("__cj")
    column = Window.partitionBy("survey_id", "__cj").orderBy("__ci")
    nextof = lambda c, key, w: F.when(F.lead(key).over(w) == F.col(key) + 1, F.lead(c).over(w))
    corners = corners.withColumn("__zr", nextof("__z", "__cj", row)).withColumn("__zd", nextof("__z", "__ci", column)).withColumn("__zrd", nextof("__zr", "__ci", column))
    q = p.join(corners, ["survey_id", "__ci", "__cj"], "left")
    a, b = F.col("__fi") - F.col("__ci"), F.col("__fj") - F.col("__cj")
    weights = [("__z", (1 - a) * (1 - b)), ("__zr", (1 - a) * b), ("__zd", a * (1 - b)), ("__zrd", a * b)]
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, w in weights:
        total = total + F.coalesce(F.col(c) * w, F.lit(0.0))
        weight = weight + F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    value = F.when(weight > 0, total / weight)
    return q.withColumn(name, value).drop("__i0", "__i1", "__j0", "__j1", "__fi", "__fj", "__ci", "__cj", "__z", "__zr", "__zd", "__zrd")


def coarsen(raster: DataFrame, factor: int, layers: dict[str, str]) -> DataFrame:
    """Blocks of cells: layers by avg, max, min or sum."""
    how = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    keys = [F.floor(F.col(k) / factor).alias(k) for k in ("i", "j")]
    return raster.groupBy("survey_id", *keys).agg(*[how[h](c).alias(c) for c, h in layers.items()])


def voxel_first(points: DataFrame, size: float, order: list[str]) -> DataFrame:
    """The first point of each voxel."""
    voxel = [F.floor(F.col(c) / size).alias(f"v{c}") for c in "xyz"]
    keyed = points.select("*", *voxel)
    w = Window.partitionBy("survey_id", "vx", "vy", "vz").orderBy(*order)
    return keyed.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "vx", "vy", "vz")


def voxel_mean(points: DataFrame, size: float) -> DataFrame:
    """Mean position and colour of each voxel; aggregated before the exchange."""
    keys = [F.floor(F.col(c) / size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy("survey_id", *keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b")])


def voxel_size_for(points: DataFrame, target: int, size: float = 1.0, rounds: int = 6, tolerance: float = 0.12) -> float:
    """Voxel edge whose number of occupied voxels is within the tolerance of the target.

    Each round is one distinct count; the edge is scaled by the cube root of the miss.
    """
    for _ in range(rounds):
        n = points.select("survey_id", *[F.floor(F.col(c) / size) for c in "xyz"]).distinct().count()
        if not n or abs(n - target) <= tolerance * target:
            break
        size *= (n / target) ** (1 / 2.5)
    return size


def isolated_removed(points: DataFrame, size: float, least: int = 5) -> DataFrame:
    """Points with at least ``least`` points, themselves included, in the 27 voxels around them."""
    voxel = {f"v{c}": F.floor(F.col(c) / size) for c in "xyz"}
    keyed = points.withColumns(voxel)
    counts = keyed.groupBy("survey_id", "vx", "vy", "vz").agg(F.count("*").alias("k"))
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    spread = counts.withColumn("o", F.explode(offsets)).select("survey_id", *[(F.col(v) + F.col(f"o.{o}")).alias(v) for v, o in (("vx", "a"), ("vy", "b"), ("vz", "c"))], "k")
    around = spread.groupBy("survey_id", "vx", "vy", "vz").agg(F.sum("k").alias("k"))
    return keyed.join(around.where(F.col("k") >= least), ["survey_id", "vx", "vy", "vz"]).drop("vx", "vy", "vz", "k")


def within(left: DataFrame, right: DataFrame, radius: float, keep_self: bool = False) -> DataFrame:
    """Pairs of points of the same survey at most ``radius`` apart in x and z.

    Both sides have survey_id, pid, x, z. The right side is repeated into the buckets around its own, so
    one equi-join finds all; buckets have the radius as edge, which bounds what meets.
    """
    bucket = lambda c: F.floor(F.col(c) / radius)
    l = left.withColumns({"bi": bucket("z"), "bj": bucket("x")})  # noqa: E741
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    r = right.select("survey_id", *[F.col(c).alias(f"o_{c}") for c in right.columns if c != "survey_id"])
    r = r.withColumn("bi", F.explode(F.transform(around, lambda k: F.floor(F.col("o_z") / radius) + k)))
    r = r.withColumn("bj", F.explode(F.transform(around, lambda k: F.floor(F.col("o_x") / radius) + k)))
    d2 = F.pow(F.col("x") - F.col("o_x"), 2) + F.pow(F.col("z") - F.col("o_z"), 2)
    pairs = l.join(r, ["survey_id", "bi", "bj"]).withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius)
    return (pairs if keep_self else pairs.where(F.col("pid") != F.col("o_pid"))).drop("bi", "bj")


def crowded(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(survey_id, x, z) of each point with at least ``least`` points, itself included, within the radius.

    A point whose small cell (edge radius / sqrt 2) holds that many is crowded without any look around; only the
    points of sparser cells meet the points around them.
    """
    edge = radius / math.sqrt(2)
    p = points.select("survey_id", "x", "z").withColumns({"ci": F.floor(F.col("z") / edge), "cj": F.floor(F.col("x") / edge)})
    cell = ["survey_id", "ci", "cj"]
    counts = p.groupBy(*cell).agg(F.count("*").alias("n"))
    placed = p.join(counts, cell)
    full = placed.where(F.col("n") >= least).select("survey_id", "x", "z")
    asked = placed.where(F.col("n") < least).withColumn("pid", F.monotonically_increasing_id())
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])
    moved = asked.withColumn("o", F.explode(around)).select("survey_id", "pid", "x", "z", (F.col("ci") + F.col("o.a")).alias("ci"), (F.col("cj") + F.col("o.b")).alias("cj"))
    others = p.select(*cell, F.col("x").alias("ox"), F.col("z").alias("oz"))
    near = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("z") - F.col("oz"), 2)) <= radius
    met = moved.join(others, cell).where(near).groupBy("survey_id", "pid", "x", "z").agg(F.count("*").alias("n"))
    return full.unionByName(met.where(F.col("n") >= least).select("survey_id", "x", "z"))


def nearest(left: DataFrame, right: DataFrame, radius: float, k: int = 1, keep_self: bool = False, key: list[str] | None = None) -> DataFrame:
    """The k nearest points of the other side within a radius, ranked from 1; ties by pid.

    ``key`` are the columns that tell the left points of a survey apart, pid if not given.
    """
    pairs = within(left, right, radius, keep_self)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("survey_id", *(key or ["pid"])).orderBy("distance", "o_pid"))).where(F.col("rank") <= k)


def linked(points: DataFrame, distance: float) -> DataFrame:
    """(survey_id, pid, label): clusters of points with links of at most ``distance``; the label is the smallest pid.

    Points of one small cell are linked by themselves, so only pairs across cells are tested, and a pair of
    cells is one edge whatever the number of its points.
    """
    edge = distance / math.sqrt(2)
    p = points.select("survey_id", "pid", "x", "z").withColumns({"ci": F.floor(F.col("z") / edge), "cj": F.floor(F.col("x") / edge)})
    cell = p.groupBy("survey_id", "ci", "cj").agg(F.min("pid").alias("node"))
    p = p.join(cell, ["survey_id", "ci", "cj"])
    near = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)]
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near])
    other = p.withColumn("o", F.explode(around)).select("survey_id", (F.col("ci") + F.col("o.a")).alias("ci"), (F.col("cj") + F.col("o.b")).alias("cj"), F.col("node").alias("b"), F.col("x").alias("ox"), F.col("z").alias("oz"))
    close = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("z") - F.col("oz"), 2) <= distance * distance
    edges = p.join(other, ["survey_id", "ci", "cj"]).where(close).select("survey_id", F.col("node").alias("a"), "b").distinct()
    from terravane.operators.neighbour import merge_labels

    merged = merge_labels(edges)
    if merged is None:
        return p.select("survey_id", "pid", F.col("node").alias("label"))
    return p.join(merged.withColumnRenamed("label", "node"), ["survey_id", "node"], "left").select("survey_id", "pid", F.coalesce("root", "node").alias("label"))


def quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str, accuracy: int = 10_000, times: str | None = None) -> DataFrame:
    """(keys, name): the exact interpolated quantile of each group, of groups of any size.

    A mergeable sketch gives two values that enclose the rank; a second pass counts what lies below them
    and keeps, by value with its count, only what lies between, some hundredths of a per cent. ``times``
    names a key: the quantile is that of a group in which each value stands so many times.
    """
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    slack = 3.0 / accuracy  # the sketch is off by 1 / accuracy at most, and the next value must be in
    ends = df.groupBy(*keys).agg(F.percentile_approx("__v", [max(0.0, q - slack), min(1.0, q + slack)], accuracy).alias("__e"), F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    few = F.col("__n") <= accuracy
    size = F.col("__n") * F.col(times) if times else F.col("__n")
    once = (lambda k: F.floor(k / F.col(times))) if times else (lambda k: k)
    low = F.when(few | F.lit(q <= slack), F.col("__min")).otherwise(F.col("__e")[0])
    high = F.when(few | F.lit(q >= 1 - slack), F.col("__max")).otherwise(F.col("__e")[1])
    ends = ends.select(*keys, low.alias("__low"), high.alias("__high"), ((size - 1) * F.lit(float(q))).alias("__rank"))
    joined = df.join(ends, keys)
    place = F.when(F.col("__v") < F.col("__low"), F.lit(None)).otherwise(F.col("__v"))
    kept = joined.where(F.col("__v") <= F.col("__high")).groupBy(*keys, "__rank", place.alias("__v")).agg(F.count("*").alias("__c"))
    pairs = kept.groupBy(*keys, "__rank").agg(F.sum(F.when(F.col("__v").isNull(), F.col("__c")).otherwise(0)).alias("__below"), F.sort_array(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__v", "__c")))).alias("__p"))
    element = lambda k: F.aggregate("__p", F.struct((k - F.col("__below")).cast("long").alias("left"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["left"] - x["__c"]).alias("left"), F.coalesce(a["v"], F.when(a["left"] < x["__c"], x["__v"])).alias("v")), lambda a: a["v"])
    first, share = F.floor("__rank"), F.col("__rank") - F.floor("__rank")
    a = element(once(first))
    return pairs.select(*keys, F.when(share == 0, a).otherwise((1 - share) * a + share * element(once(first + 1))).alias(name))


def quantiles(df: DataFrame, keys: list[str], **wanted: tuple[str, float]) -> DataFrame:
    """(keys, names...): several quantiles, name=(column, share), null where a group has no value."""
    out = df.select(*keys).distinct()
    for name, (value, q) in wanted.items():
        out = out.join(quantile(df, keys, value, q, name), keys, "left")
    return out


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 in an order over all rows: range partitions, their sizes, and numbers inside each.

    The partitioned rows are checkpointed, so that the numbers rest on one partitioning; the sizes of the
    partitions are all that reaches the driver.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k] = total
        total += sizes[k]
    if not sizes:
        return parts.drop("__part").withColumn(name, F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__part"))
    return parts.withColumn(name, (F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + offset).cast("long")).drop("__part")


def plane_noise(points: DataFrame, res: float, least: int = 6) -> DataFrame:
    """Noise of each survey: median over small cells of the residual of the cell's own plane."""
    p = with_cell(points, res)
    m = p.groupBy(*CELL).agg(
        F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in ("xx", "zz", "xz", "xy", "zy", "yy")]
    ).where(F.col("n") >= least)
    det = F.col("cxx") * F.col("czz") - F.col("cxz") * F.col("cxz")
    bx, bz = (F.col("cxy") * F.col("czz") - F.col("czy") * F.col("cxz")) / det, (F.col("czy") * F.col("cxx") - F.col("cxy") * F.col("cxz")) / det
    rss = F.greatest(F.lit(0.0), F.col("cyy") - bx * F.col("cxy") - bz * F.col("czy")) * F.col("n")
    sigma = m.where(det > 1e-9).withColumn("sigma", F.sqrt(rss / (F.col("n") - 3)))
    return quantile(sigma, ["survey_id"], "sigma", 0.5, "sigma").join(sigma.groupBy("survey_id").agg(F.count("*").alias("cells")), "survey_id")


def mad_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median absolute deviation of each group."""
    off = df.join(quantile(df, keys, value, 0.5, "__mid"), keys).withColumn("__off", F.abs(F.col(value) - F.col("__mid")))
    return quantile(off, keys, "__off", 0.5, "__mad").select(*keys, (1.4826 * F.col("__mad")).alias("sigma"))


def geomspace_radii(reach_m: float, res: float, steps: int = 9) -> list[int]:
    """Distinct whole radii in cells, in geometric steps from one cell to the reach."""
    top = max(2, round(reach_m / res))
    return sorted({round(math.exp(math.log(top) * k / (steps - 1))) for k in range(steps)})


def object_cells(raster: DataFrame, layer: str, res: float, reach_m: float = 18.0, rise: float = 0.15) -> DataFrame:
    """Progressive opening: cells that stand above the opened surface of some radius are objects.

    Each radius is two separable window passes over lines of the raster.
    """
    out = raster.withColumn("__prev", F.col(layer)).withColumn("object", F.col(layer).isNull())
    for r in geomspace_radii(reach_m, res):
        out = opening(out, "__prev", r, "__open")
        out = out.withColumn("object", F.col("object") | F.coalesce(F.col("__prev") - F.col("__open") > max(0.25, rise * r * res), F.lit(False)))
        out = out.withColumn("__prev", F.col("__open")).drop("__open")
    return out.drop("__prev")
