"""Queries over points and rasters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import grid as G
from terravane.plans.fixtures import POINTS_SQL, cells_sql, dense_sql, points, square_sql
from terravane.session import read

QUERIES, ORACLE = {}, {}
RES = 2.5


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register




def raster(spark: SparkSession, d: str, res: float = RES) -> DataFrame:
    return G.dense(G.cells(points(spark, d), res))


def rounded(df: DataFrame, keys: list[str], *layers: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Keys and rounded layers; a nudge keeps means of short decimals off the ties of rounding."""
    return df.select(*keys, *[F.round(F.col(c) + nudge, digits).alias(c) for c in layers])


@query("flagship_height_ceiling", f"""WITH {cells_sql(5.0)} SELECT survey_id, count(*) AS cells, round(avg(zhi - zlo), 6) AS mean_m, CAST(count(*) FILTER (WHERE zhi - zlo > 5) AS BIGINT) AS above, round(max(zhi - zlo), 6) AS peak_m FROM cells GROUP BY survey_id""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Height above each cell's own base: share of cells and peak above a ceiling of 5 m."""
    h = F.col("zhi") - F.col("zlo")
    return G.cells(points(spark, d), 5.0).groupBy("survey_id").agg(F.count("*").alias("cells"), F.round(F.avg(h), 6).alias("mean_m"), F.count_if(h > 5).alias("above"), F.round(F.max(h), 6).alias("peak_m"))


@query("e01_cell_binning", f"WITH {POINTS_SQL} SELECT survey_id, CAST(floor(z / 2.5) AS BIGINT) * 40 + CAST(floor(x / 2.5) AS BIGINT) AS key, count(*) AS n FROM pts WHERE x BETWEEN 10 AND 90 AND z BETWEEN 10 AND 90 GROUP BY ALL")
def e01(spark: SparkSession, d: str) -> DataFrame:
    binned = G.with_cell(G.inside(points(spark, d), 10, 90, 10, 90), RES)
    return binned.groupBy("survey_id", (F.col("i") * 40 + F.col("j")).alias("key")).agg(F.count("*").alias("n"))


@query("e02_cell_quantiles", f"WITH {cells_sql(RES)} SELECT survey_id, i, j, n, round(zlo, 6) AS zlo, round(zmed, 6) AS zmed, round(zhi, 6) AS zhi, round(zmax, 6) AS zmax FROM cells")
def e02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.cells(points(spark, d), RES), [*G.CELL, "n"], "zlo", "zmed", "zhi", "zmax")


@query("e03_top_surface_colour", f"WITH {cells_sql(RES)} SELECT survey_id, i, j, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM cells")
def e03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.cells(points(spark, d), RES), G.CELL, "r", "g", "b")


@query("e04_robust_extent", f"""WITH {POINTS_SQL} SELECT survey_id, round(quantile_cont(x, 0.0005) - 25, 6) AS x0, round(quantile_cont(x, 0.9995) + 25, 6) AS x1,
    round(quantile_cont(z, 0.0005) - 25, 6) AS z0, round(quantile_cont(z, 0.9995) + 25, 6) AS z1 FROM pts GROUP BY survey_id""")
def e04(spark: SparkSession, d: str) -> DataFrame:
    ends = G.quantiles(points(spark, d), ["survey_id"], x0=("x", 0.0005), x1=("x", 0.9995), z0=("z", 0.0005), z1=("z", 0.9995))
    pad = {"0": -10 * RES, "1": 10 * RES}
    return ends.select("survey_id", *[F.round(F.col(c) + pad[c[1]], 6).alias(c) for c in ("x0", "x1", "z0", "z1")])


CAMERAS = "cams AS (SELECT s.survey_id, s_suppkey AS pid, CAST(s_suppkey * 37 % 100 AS DOUBLE) AS x, CAST(s_suppkey * 61 % 100 AS DOUBLE) AS z, 30.0 AS y FROM supplier, (SELECT unnest(['day1', 'day2']) AS survey_id) s)"


def cameras(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    days = F.explode(F.array(F.lit("day1"), F.lit("day2"))).alias("survey_id")
    return read(spark, d, "supplier").select(days, key.alias("pid"), (key * 37 % 100).cast("double").alias("x"), (key * 61 % 100).cast("double").alias("z"), F.lit(30.0).alias("y"))


@query("e05_grazing_angle", f"""WITH {cells_sql(RES)}, {CAMERAS}, n AS (SELECT c.survey_id, c.i, c.j, c.zhi, k.y, sqrt(pow((c.j + 0.5) * 2.5 - k.x, 2) + pow((c.i + 0.5) * 2.5 - k.z, 2)) AS dist, k.pid FROM cells c JOIN cams k ON c.survey_id = k.survey_id),
    b AS (SELECT survey_id, i, j, min(row(dist, pid, y, zhi)) AS m FROM n WHERE dist <= 20 GROUP BY survey_id, i, j)
    SELECT survey_id, i, j, round(degrees(atan2(m[3] - m[4], greatest(m[1], 1e-6))), 5) AS angle, degrees(atan2(m[3] - m[4], greatest(m[1], 1e-6))) >= 8 AS seen FROM b""")
def e05(spark: SparkSession, d: str) -> DataFrame:
    c = G.cells(points(spark, d), RES).select("survey_id", "i", "j", ((F.col("j") + 0.5) * RES).alias("x"), ((F.col("i") + 0.5) * RES).alias("z"), "zhi")
    near = G.nearest(c, cameras(spark, d), 20.0, keep_self=True, key=["i", "j"])
    angle = F.degrees(F.atan2(F.col("o_y") - F.col("zhi"), F.greatest(F.col("distance"), F.lit(1e-6))))
    return near.select("survey_id", "i", "j", F.round(angle, 5).alias("angle"), (angle >= 8).alias("seen"))


@query("e10_low_outliers", f"""WITH {cells_sql(RES)}, b AS (SELECT survey_id, i // 2 AS bi, j // 2 AS bj, quantile_cont(zlo, 0.5) AS m FROM cells GROUP BY ALL),
    s AS (SELECT c.survey_id, c.bi, c.bj, (SELECT quantile_cont(o.m, 0.5) FROM b o WHERE o.survey_id = c.survey_id AND abs(o.bi - c.bi) <= 2 AND abs(o.bj - c.bj) <= 2) AS ref FROM b c)
    SELECT cells.survey_id, cells.i, cells.j FROM cells JOIN s ON s.survey_id = cells.survey_id AND s.bi = i // 2 AND s.bj = j // 2 WHERE zlo < ref - 0.2""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    """Cells below the smoothed surface of block medians."""
    c = G.cells(points(spark, d), RES).withColumns({"bi": F.floor(F.col("i") / 2), "bj": F.floor(F.col("j") / 2)})
    blocks = c.groupBy("survey_id", "bi", "bj").agg(F.percentile("zlo", F.lit(0.5)).alias("m"))
    offsets = F.sequence(F.lit(-2), F.lit(2))
    spread = blocks.withColumn("di", F.explode(offsets)).withColumn("dj", F.explode(offsets))
    ref = spread.groupBy("survey_id", (F.col("bi") + F.col("di")).alias("bi"), (F.col("bj") + F.col("dj")).alias("bj")).agg(F.percentile("m", F.lit(0.5)).alias("ref"))
    return c.join(ref, ["survey_id", "bi", "bj"]).where("zlo < ref - 0.2").select(*G.CELL)


@query("e11_progressive_opening")
def e11(spark: SparkSession, d: str) -> DataFrame:
    """Cells that are objects above the opened minimum surface."""
    return G.object_cells(raster(spark, d), "zmed", RES).where("object").select(*G.CELL)


@query("f06_grey_opening", f"""WITH {dense_sql(RES)}, e AS MATERIALIZED (SELECT c.survey_id, c.i, c.j, {square_sql('min(o.zlo)', 2)} AS m FROM grid c)
    SELECT c.survey_id, c.i, c.j, round((SELECT max(o.m) FROM e o WHERE o.survey_id = c.survey_id AND o.i BETWEEN c.i - 2 AND c.i + 2 AND o.j BETWEEN c.j - 2 AND c.j + 2), 6) AS opened FROM e c""")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.opening(raster(spark, d), "zlo", 2, "opened"), G.CELL, "opened")


@query("f04_box_mean", f"WITH {dense_sql(RES)} SELECT c.survey_id, c.i, c.j, round({square_sql('avg(o.zmed)', 2)} + 1e-8, 5) AS mean FROM grid c")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.box_mean(raster(spark, d), "zmed", 2, "mean"), G.CELL, "mean", digits=5, nudge=1e-8)


@query("f04_max_min_range", f"WITH {dense_sql(RES)} SELECT c.survey_id, c.i, c.j, round({square_sql('max(o.zhi) - min(o.zhi)', 1)}, 6) AS step FROM grid c")
def f04b(spark: SparkSession, d: str) -> DataFrame:
    out = G.box(raster(spark, d), 1, top=("zhi", "max"), low=("zhi", "min"))
    return out.select(*G.CELL, F.round(F.col("top") - F.col("low"), 6).alias("step"))


@query("e13_surface_and_slope", f"""WITH {dense_sql(RES)}, n AS (SELECT *, lag(zmed) OVER a AS l, lead(zmed) OVER a AS r_, lag(zmed) OVER b AS u, lead(zmed) OVER b AS d FROM grid
      WINDOW a AS (PARTITION BY survey_id, i ORDER BY j), b AS (PARTITION BY survey_id, j ORDER BY i)),
    g AS (SELECT *, CASE WHEN l IS NOT NULL AND r_ IS NOT NULL THEN (r_ - l) / 5 WHEN r_ IS NOT NULL THEN (r_ - zmed) / 2.5 WHEN l IS NOT NULL THEN (zmed - l) / 2.5 ELSE 0 END AS gx,
      CASE WHEN u IS NOT NULL AND d IS NOT NULL THEN (d - u) / 5 WHEN d IS NOT NULL THEN (d - zmed) / 2.5 WHEN u IS NOT NULL THEN (zmed - u) / 2.5 ELSE 0 END AS gz FROM n)
    SELECT survey_id, i, j, round(zhi - zlo, 6) AS ndsm, round(CASE WHEN zmed IS NOT NULL THEN degrees(atan(sqrt(gx * gx + gz * gz))) END, 5) AS slope FROM g""")
def e13(spark: SparkSession, d: str) -> DataFrame:
    out = G.slope_degrees(raster(spark, d), "zmed", RES)
    return out.select(*G.CELL, F.round(F.col("zhi") - F.col("zlo"), 6).alias("ndsm"), F.round("slope", 5).alias("slope"))


@query("e14_plane_roughness", f"""WITH {dense_sql(RES)}, w AS (SELECT c.survey_id, c.i, c.j, o.i - c.i AS di, o.j - c.j AS dj, o.zhi AS z FROM grid c JOIN grid o ON o.survey_id = c.survey_id AND abs(o.i - c.i) <= 2 AND abs(o.j - c.j) <= 2 AND o.zhi IS NOT NULL),
    m AS (SELECT survey_id, i, j, count(*) AS n, covar_pop(di, di) AS a, covar_pop(dj, dj) AS b, covar_pop(di, dj) AS c, covar_pop(di, z) AS e, covar_pop(dj, z) AS f, var_pop(z) AS v FROM w GROUP BY ALL)
    SELECT survey_id, i, j, round(CASE WHEN n >= 6 AND abs(a * b - c * c) * n * n > 1e-9 THEN sqrt(greatest(0, v - e * (e * b - f * c) / (a * b - c * c) - f * (f * a - e * c) / (a * b - c * c)) * n / (n - 3)) END, 5) AS rough FROM m""")
def e14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.plane_rms(raster(spark, d), "zhi", 2), G.CELL, "rough", digits=5)


@query("e15_colour_indices", f"""WITH {cells_sql(RES)} SELECT survey_id, i, j, round((2 * g - r - b) / (r + g + b + 1e-6), 6) AS exg, round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1e-6) ELSE 0 END, 6) AS sat, round(greatest(r, g, b) / 255.0, 6) AS val FROM cells""")
def e15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.colour_indices(G.cells(points(spark, d), RES)), G.CELL, "exg", "sat", "val")


@query("e16_hue", f"""WITH {cells_sql(RES)}, h AS (SELECT *, greatest(r, g, b) - least(r, g, b) AS d, greatest(r, g, b) AS t FROM cells),
    s AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN t = r THEN (g - b) / d WHEN t = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60.0 AS x FROM h)
    SELECT survey_id, i, j, round(CASE WHEN x < 0 THEN x + 360 ELSE x END, 5) AS hue FROM s""")
def e16(spark: SparkSession, d: str) -> DataFrame:
    h = G.hue(F.col("r"), F.col("g"), F.col("b"))
    return G.cells(points(spark, d), RES).select(*G.CELL, F.round(h, 5).alias("hue"))


SAMPLED = f"""{dense_sql(5.0)}, p AS (SELECT p.*, greatest(i0, least(i1, z / 5.0 - 0.5)) AS fi, greatest(j0, least(j1, x / 5.0 - 0.5)) AS fj FROM pts p JOIN box USING (survey_id)),
    q AS (SELECT *, CAST(floor(fi) AS BIGINT) AS ci, CAST(floor(fj) AS BIGINT) AS cj, fi - floor(fi) AS a, fj - floor(fj) AS b_ FROM p),
    s AS (SELECT q.survey_id, q.okey, q.x, q.z, q.y, (coalesce(c00.zlo * (1 - a) * (1 - b_), 0) + coalesce(c01.zlo * (1 - a) * b_, 0) + coalesce(c10.zlo * a * (1 - b_), 0) + coalesce(c11.zlo * a * b_, 0))
      / nullif(CASE WHEN c00.zlo IS NULL THEN 0 ELSE (1 - a) * (1 - b_) END + CASE WHEN c01.zlo IS NULL THEN 0 ELSE (1 - a) * b_ END + CASE WHEN c10.zlo IS NULL THEN 0 ELSE a * (1 - b_) END + CASE WHEN c11.zlo IS NULL THEN 0 ELSE a * b_ END, 0) AS base
      FROM q LEFT JOIN cells c00 ON c00.survey_id = q.survey_id AND c00.i = ci AND c00.j = cj LEFT JOIN cells c01 ON c01.survey_id = q.survey_id AND c01.i = ci AND c01.j = cj + 1
      LEFT JOIN cells c10 ON c10.survey_id = q.survey_id AND c10.i = ci + 1 AND c10.j = cj LEFT JOIN cells c11 ON c11.survey_id = q.survey_id AND c11.i = ci + 1 AND c11.j = cj + 1)"""


def heights(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    sampled = G.sample_bilinear(p, G.cells(p, 5.0), "zlo", 5.0, "base")
    return sampled.withColumn("height", F.col("y") - F.col("base"))


@query("e19_bilinear_sampling", f"WITH {SAMPLED} SELECT survey_id, CAST(floor(z / 10) AS BIGINT) AS band, count(*) AS n, round(avg(base), 5) AS base FROM s GROUP BY ALL")
def e19(spark: SparkSession, d: str) -> DataFrame:
    return heights(spark, d).groupBy("survey_id", F.floor(F.col("z") / 10).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("base"), 5).alias("base"))


@query("e20_height_above_ground", f"WITH {SAMPLED} SELECT survey_id, count(*) AS n, round(avg(y - base), 5) AS mean_m, round(min(y - base), 5) AS low_m, round(max(y - base), 5) AS high_m FROM s GROUP BY survey_id")
def e20(spark: SparkSession, d: str) -> DataFrame:
    return heights(spark, d).groupBy("survey_id").agg(F.count("*").alias("n"), *[F.round(f("height"), 5).alias(n) for n, f in (("mean_m", F.avg), ("low_m", F.min), ("high_m", F.max))])


@query("e36_height_ceiling_audit", f"WITH {SAMPLED} SELECT survey_id, CAST(count(*) FILTER (WHERE y - base > 8) AS BIGINT) AS above, round(100.0 * count(*) FILTER (WHERE y - base > 8) / count(*), 5) AS percent, round(max(y - base), 5) AS peak_m FROM s GROUP BY survey_id")
def e36(spark: SparkSession, d: str) -> DataFrame:
    over = F.count_if(F.col("height") > 8)
    return heights(spark, d).groupBy("survey_id").agg(over.alias("above"), F.round(100.0 * over / F.count("*"), 5).alias("percent"), F.round(F.max("height"), 5).alias("peak_m"))


@query("e21_coarsen", f"WITH {cells_sql(RES)} SELECT survey_id, i // 4 AS i, j // 4 AS j, round(avg(zlo) + 1e-9, 6) AS zlo, round(max(zhi) + 1e-9, 6) AS zhi, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY survey_id, i // 4, j // 4")
def e21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.coarsen(G.cells(points(spark, d), RES), 4, {"zlo": "avg", "zhi": "max", "n": "sum"}), [*G.CELL, "n"], "zlo", "zhi", nudge=1e-9)


@query("e25_downsampled_grid", f"WITH {cells_sql(RES)} SELECT survey_id, i, j, round(zhi, 6) AS zhi FROM cells WHERE i % 3 = 0 AND j % 3 = 0")
def e25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.cells(points(spark, d), RES).where("i % 3 = 0 AND j % 3 = 0"), G.CELL, "zhi")


CLASSED = """CASE WHEN h < 0.35 THEN 'ground' WHEN h < 1.2 AND exg > 0.04 THEN 'low_vegetation' WHEN h < 1.2 THEN 'ground' WHEN exg > 0.04 THEN 'tree' ELSE 'building' END"""


def classes(spark: SparkSession, d: str, res: float = RES) -> DataFrame:
    """Cells with the class of their own height and colour."""
    c = G.colour_indices(G.cells(points(spark, d), res)).withColumn("h", F.col("zhi") - F.col("zlo"))
    return c.withColumn("cls", F.expr(CLASSED))


CLASS_SQL = f"cls AS (SELECT *, {CLASSED} AS cls FROM (SELECT *, zhi - zlo AS h, (2 * g - r - b) / (r + g + b + 1e-6) AS exg FROM cells))"


@query("e23_class_summary", f"WITH {cells_sql(RES)}, {CLASS_SQL} SELECT survey_id, cls, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY survey_id), 5) AS percent FROM cls GROUP BY survey_id, cls")
def e23(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = classes(spark, d).groupBy("survey_id", "cls").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("survey_id"))
    return counts.select("survey_id", "cls", "n", F.round(share, 5).alias("percent"))


@query("e27_orthophoto", f"""WITH {POINTS_SQL} SELECT survey_id, CAST(floor(z / 1.5) AS BIGINT) AS i, CAST(floor(x / 1.5) AS BIGINT) AS j, max(row(y, r, g, b))[2] AS r, max(row(y, r, g, b))[3] AS g, max(row(y, r, g, b))[4] AS b FROM pts GROUP BY ALL""")
def e27(spark: SparkSession, d: str) -> DataFrame:
    """Colour of the topmost point of each cell."""
    top = G.with_cell(points(spark, d), 1.5).groupBy(*G.CELL).agg(F.max(F.struct("y", "r", "g", "b")).alias("t"))
    return top.select(*G.CELL, "t.r", "t.g", "t.b")


@query("e28_point_classes", f"""WITH {SAMPLED}, h AS (SELECT survey_id, y - base AS h FROM s) SELECT survey_id, CASE WHEN h < -1 THEN 7 WHEN h < 0.3 THEN 2 WHEN h < 0.5 THEN 3 WHEN h < 2 THEN 4 ELSE 5 END AS code, count(*) AS n FROM h GROUP BY ALL""")
def e28(spark: SparkSession, d: str) -> DataFrame:
    """Classes of exchange formats by height above ground; the noise rule overrides all others."""
    h = F.col("height")
    code = F.when(h < -1, 7).when(h < 0.3, 2).when(h < 0.5, 3).when(h < 2, 4).otherwise(5)
    return heights(spark, d).groupBy("survey_id", code.alias("code")).agg(F.count("*").alias("n"))


@query("e30_surface_noise", f"""WITH {POINTS_SQL}, m AS (SELECT survey_id, CAST(floor(z / 2.5) AS BIGINT) AS i, CAST(floor(x / 2.5) AS BIGINT) AS j, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(y, y) AS yy FROM pts GROUP BY ALL HAVING count(*) >= 6),
    s AS (SELECT survey_id, sqrt(greatest(0, yy - xy * (xy * zz - zy * xz) / (xx * zz - xz * xz) - zy * (zy * xx - xy * xz) / (xx * zz - xz * xz)) * n / (n - 3)) AS sigma FROM m WHERE xx * zz - xz * xz > 1e-9)
    SELECT survey_id, round(quantile_cont(sigma, 0.5), 5) AS sigma, count(*) AS cells FROM s GROUP BY survey_id""")
def e30(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.plane_noise(points(spark, d), RES), ["survey_id", "cells"], "sigma", digits=5)


@query("e31_bare_earth_points", f"""WITH {POINTS_SQL} SELECT survey_id, CAST(floor(z / 1.5) AS BIGINT) AS i, CAST(floor(x / 1.5) AS BIGINT) AS j, round(quantile_cont(x, 0.5), 5) AS x, round(quantile_cont(z, 0.5), 5) AS z, round(quantile_cont(y, 0.2), 5) AS y FROM pts GROUP BY ALL HAVING count(*) >= 5""")
def e31(spark: SparkSession, d: str) -> DataFrame:
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 5).alias(c)
    g = G.with_cell(points(spark, d), 1.5).groupBy(*G.CELL).agg(F.count("*").alias("n"), q("x", 0.5), q("z", 0.5), q("y", 0.2))
    return g.where("n >= 5").drop("n")


FIRST = "first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY survey_id, floor(x / 2), floor(y / 2), floor(z / 2) ORDER BY okey, lno, pkey, skey, x, y, z, r, g, b) AS k FROM pts) WHERE k = 1)"
ORDER = ["okey", "lno", "pkey", "skey", "x", "y", "z", "r", "g", "b"]


@query("e32_grid_decimation", f"WITH {POINTS_SQL}, {FIRST} SELECT survey_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM first_")
def e32(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.voxel_first(points(spark, d), 2.0, ORDER), ["survey_id"], "x", "y", "z")


@query("e33_voxel_means", f"""WITH {POINTS_SQL} SELECT survey_id, count(*) AS n, round(avg(x) + 1e-8, 5) AS x, round(avg(y) + 1e-8, 5) AS y, round(avg(z) + 1e-8, 5) AS z, round(avg(r) + 1e-8, 5) AS r FROM pts GROUP BY survey_id, floor(x / 3), floor(y / 3), floor(z / 3)""")
def e33(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.voxel_mean(points(spark, d), 3.0), ["survey_id", "n"], "x", "y", "z", "r", digits=5, nudge=1e-8)


@query("e34_isolated_points_removed", f"""WITH {POINTS_SQL}, v AS (SELECT survey_id, CAST(floor(x / 2) AS BIGINT) AS a, CAST(floor(y / 2) AS BIGINT) AS b, CAST(floor(z / 2) AS BIGINT) AS c, count(*) AS k FROM pts GROUP BY ALL),
    s AS (SELECT v.survey_id, v.a, v.b, v.c, any_value(v.k) AS k, sum(o.k) AS m FROM v JOIN v o ON o.survey_id = v.survey_id AND abs(o.a - v.a) <= 1 AND abs(o.b - v.b) <= 1 AND abs(o.c - v.c) <= 1 GROUP BY v.survey_id, v.a, v.b, v.c)
    SELECT survey_id, CAST(sum(k) AS BIGINT) AS kept FROM s WHERE m >= 40 GROUP BY survey_id""")
def e34(spark: SparkSession, d: str) -> DataFrame:
    return G.isolated_removed(points(spark, d), 2.0, 40).groupBy("survey_id").agg(F.count("*").alias("kept"))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return G.voxel_first(points(spark, d), 2.0, ORDER).withColumn("pid", F.xxhash64(*ORDER))


NUMBERED = f"{POINTS_SQL}, {FIRST}, num AS (SELECT *, row_number() OVER (ORDER BY okey, lno, pkey, skey, x, y, z) AS id FROM first_)"


@query("e35_point_spacing", f"""WITH {NUMBERED}, n AS (SELECT p.survey_id, p.id, min(sqrt(pow(p.x - o.x, 2) + pow(p.z - o.z, 2))) AS m FROM num p JOIN num o ON o.survey_id = p.survey_id AND o.id <> p.id AND abs(o.x - p.x) <= 2 AND abs(o.z - p.z) <= 2 WHERE sqrt(pow(p.x - o.x, 2) + pow(p.z - o.z, 2)) <= 2 GROUP BY p.survey_id, p.id)
    SELECT survey_id, count(*) AS n, round(quantile_cont(m, 0.5), 5) AS spacing FROM n GROUP BY survey_id""")
def e35(spark: SparkSession, d: str) -> DataFrame:
    p = sparse(spark, d).select("survey_id", "pid", "x", "z")
    gaps = G.within(p, p, 2.0).groupBy("survey_id", "pid").agg(F.min("distance").alias("m"))
    spacing = G.quantile(gaps, ["survey_id"], "m", 0.5, "spacing")
    return gaps.groupBy("survey_id").agg(F.count("*").alias("n")).join(spacing, "survey_id").select("survey_id", "n", F.round("spacing", 5).alias("spacing"))


@query("f18_nearest_neighbours", f"""WITH {NUMBERED}, n AS (SELECT p.survey_id, p.id, sqrt(pow(p.x - o.x, 2) + pow(p.z - o.z, 2)) AS m FROM num p JOIN num o ON o.survey_id = p.survey_id AND o.id <> p.id AND abs(o.x - p.x) <= 2 AND abs(o.z - p.z) <= 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY survey_id, id ORDER BY m) AS k FROM n WHERE m <= 2)
    SELECT survey_id, CAST(k AS INT) AS rank, count(*) AS n, round(avg(m), 5) AS mean_m FROM k WHERE k <= 3 GROUP BY survey_id, k""")
def f18(spark: SparkSession, d: str) -> DataFrame:
    p = sparse(spark, d).select("survey_id", "pid", "x", "z")
    near = G.nearest(p, p, 2.0, k=3)
    return near.groupBy("survey_id", "rank").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 5).alias("mean_m"))


@query("e37_mad_sigma", f"""WITH {POINTS_SQL}, m AS (SELECT survey_id, quantile_cont(y, 0.5) AS m FROM pts GROUP BY survey_id) SELECT survey_id, round(1.4826 * quantile_cont(abs(y - m), 0.5), 5) AS sigma FROM pts JOIN m USING (survey_id) GROUP BY survey_id""")
def e37(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.mad_sigma(points(spark, d), ["survey_id"], "y"), ["survey_id"], "sigma", digits=5)


@query("e38_height_histogram", f"""WITH {POINTS_SQL} SELECT survey_id, CAST(floor(y / 0.5) AS BIGINT) AS bin, count(*) AS n FROM pts GROUP BY ALL""")
def e38(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("survey_id", F.floor(F.col("y") / 0.5).alias("bin")).agg(F.count("*").alias("n"))


@query("f08_class_statistics", f"""WITH {cells_sql(RES)}, {CLASS_SQL} SELECT survey_id, cls, count(*) AS n, round(count(*) * 6.25, 4) AS area_m2, round(quantile_cont(h, 0.5), 5) AS mid_h, round(max(h), 5) AS top_h, round(avg(i), 5) AS ci, round(avg(j), 5) AS cj, min(i) AS i0, max(i) AS i1 FROM cls GROUP BY survey_id, cls""")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).groupBy("survey_id", "cls").agg(
        F.count("*").alias("n"), F.round(F.count("*") * 6.25, 4).alias("area_m2"), F.round(F.percentile("h", F.lit(0.5)), 5).alias("mid_h"), F.round(F.max("h"), 5).alias("top_h"),
        F.round(F.avg("i"), 5).alias("ci"), F.round(F.avg("j"), 5).alias("cj"), F.min("i").alias("i0"), F.max("i").alias("i1"),
    )


@query("f23_points_in_cells", f"""WITH {cells_sql(RES)}, {CLASS_SQL} SELECT p.survey_id, count(*) AS n, round(avg(p.y), 5) AS mean_y FROM pts p WHERE EXISTS (SELECT 1 FROM cls WHERE cls.cls = 'tree' AND cls.survey_id = p.survey_id AND cls.i = CAST(floor(p.z / 2.5) AS BIGINT) AND cls.j = CAST(floor(p.x / 2.5) AS BIGINT)) GROUP BY p.survey_id""")
def f23(spark: SparkSession, d: str) -> DataFrame:
    mask = classes(spark, d).where("cls = 'tree'").select(*G.CELL)
    hit = G.with_cell(points(spark, d), RES).join(mask, G.CELL, "left_semi")
    return hit.groupBy("survey_id").agg(F.count("*").alias("n"), F.round(F.avg("y"), 5).alias("mean_y"))
