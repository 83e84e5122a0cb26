"""Queries over neighbourhoods, components, sight, ways, structures, roads and change, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.operators import grid as G
from terravane.operators import kernels as K
from terravane.operators import neighbour as N
from terravane.plans.fixtures import cells_sql, dense_sql, points, square_sql
from terravane.plans.terrain import CLASS_SQL, RES, classes, raster

QUERIES, ORACLE = {}, {}
CELL = G.CELL


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


C = f"WITH RECURSIVE {cells_sql(RES)}, {CLASS_SQL}, mask AS (SELECT survey_id, i, j FROM cls WHERE cls = 'tree')"


def mask(spark: SparkSession, d: str, cls: str = "tree") -> DataFrame:
    return classes(spark, d).where(F.col("cls") == cls).select(*CELL)


@query("f01_dilate", f"{C} SELECT DISTINCT survey_id, CAST(i + a AS BIGINT) AS i, CAST(j + b AS BIGINT) AS j FROM mask, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b)")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return N.dilate(mask(spark, d), 1, square=True)


WIDE = f"WITH RECURSIVE {cells_sql(RES)}, {CLASS_SQL}, mask AS (SELECT survey_id, i, j FROM cls WHERE h > 7.5)"


@query("f01_erode", f"{WIDE} SELECT m.survey_id, m.i, m.j FROM mask m JOIN mask o ON o.survey_id = m.survey_id AND abs(o.i - m.i) <= 1 AND abs(o.j - m.j) <= 1 GROUP BY ALL HAVING count(*) = 9")
def f01b(spark: SparkSession, d: str) -> DataFrame:
    return N.erode(high(spark, d, 7.5), 1, square=True)


@query("f01_open", f"""{WIDE}, e AS (SELECT m.survey_id, m.i, m.j FROM mask m JOIN mask o ON o.survey_id = m.survey_id AND abs(o.i - m.i) <= 1 AND abs(o.j - m.j) <= 1 GROUP BY ALL HAVING count(*) = 9)
    SELECT DISTINCT survey_id, CAST(i + a AS BIGINT) AS i, CAST(j + b AS BIGINT) AS j FROM e, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b)""")
def f01c(spark: SparkSession, d: str) -> DataFrame:
    return N.open_mask(high(spark, d, 7.5), 1)


@query("f02_disk_dilation", f"{C}, k AS (SELECT unnest(range(-3, 4)) AS a), o AS (SELECT x.a, y.a AS b FROM k x, k y WHERE x.a * x.a + y.a * y.a <= 9) SELECT DISTINCT survey_id, CAST(i + a AS BIGINT) AS i, CAST(j + b AS BIGINT) AS j FROM mask, o")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return N.dilate(mask(spark, d), 3)


@query("f03_distance_transform", f"""{C} SELECT c.survey_id, c.i, c.j, round(sqrt(min(pow(o.i - c.i, 2) + pow(o.j - c.j, 2))), 6) AS distance FROM cells c LEFT JOIN mask o ON o.survey_id = c.survey_id GROUP BY ALL""")
def f03(spark: SparkSession, d: str) -> DataFrame:
    c = classes(spark, d).select(*CELL)
    return N.distance_to(c, mask(spark, d)).select(*CELL, F.round("distance", 6).alias("distance"))


@query("f05_nearest_fill", f"""WITH {dense_sql(RES)}, k AS (SELECT survey_id, i, j, CASE WHEN (i + j) % 3 = 0 THEN zmed END AS v FROM grid), n AS (SELECT c.survey_id, c.i, c.j, min(row(CAST(pow(o.i - c.i, 2) + pow(o.j - c.j, 2) AS BIGINT), o.i, o.j, o.v)) AS m FROM k c JOIN k o ON o.survey_id = c.survey_id AND o.v IS NOT NULL GROUP BY ALL)
    SELECT k.survey_id, k.i, k.j, round(coalesce(k.v, m[4]), 6) AS filled FROM k LEFT JOIN n ON n.survey_id = k.survey_id AND n.i = k.i AND n.j = k.j""")
def f05(spark: SparkSession, d: str) -> DataFrame:
    thinned = raster(spark, d).select(*CELL, F.when((F.col("i") + F.col("j")) % 3 == 0, F.col("zmed")).alias("v"))
    return N.nearest_fill(thinned, "v", "filled").select(*CELL, F.round("filled", 6).alias("filled"))


@query("e29_masked_smoothing", f"""WITH {dense_sql(RES)} SELECT c.survey_id, c.i, c.j, round(sum(o.zmed * exp(-(pow(o.i - c.i, 2) + pow(o.j - c.j, 2)) / 2.0)) / sum(exp(-(pow(o.i - c.i, 2) + pow(o.j - c.j, 2)) / 2.0)), 5) AS smooth
    FROM grid c JOIN grid o ON o.survey_id = c.survey_id AND pow(o.i - c.i, 2) + pow(o.j - c.j, 2) <= 9 AND o.zmed IS NOT NULL GROUP BY ALL""")
def e29(spark: SparkSession, d: str) -> DataFrame:
    return N.smooth(raster(spark, d).select(*CELL, "zmed"), "zmed", 1.0, "smooth").select(*CELL, F.round("smooth", 5).alias("smooth"))


REACH = "reach AS (SELECT survey_id, i, j, i AS oi, j AS oj FROM mask UNION SELECT r.survey_id, r.i, r.j, o.i, o.j FROM reach r JOIN mask o ON o.survey_id = r.survey_id AND abs(o.i - r.oi) <= 1 AND abs(o.j - r.oj) <= 1), lab AS (SELECT survey_id, i, j, min(oi * 2147483648 + oj) AS label FROM reach GROUP BY ALL)"
HIGH = f"WITH RECURSIVE {cells_sql(RES)}, {CLASS_SQL}, mask AS (SELECT survey_id, i, j FROM cls WHERE h > 9.35)"


def high(spark: SparkSession, d: str, above: float = 9.35) -> DataFrame:
    return classes(spark, d).where(F.col("h") > above).select(*CELL)


@query("f07_components", f"{HIGH}, {REACH} SELECT survey_id, i, j, CAST(label AS BIGINT) AS label FROM lab")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return N.components(high(spark, d))


@query("f09_hysteresis", f"""{HIGH}, {REACH}, s AS (SELECT DISTINCT lab.survey_id, label FROM lab JOIN cls USING (survey_id, i, j) WHERE h > 9.6) SELECT lab.survey_id, i, j FROM lab JOIN s ON s.survey_id = lab.survey_id AND s.label = lab.label""")
def f09(spark: SparkSession, d: str) -> DataFrame:
    return N.grow(high(spark, d, 9.6), high(spark, d))


@query("f10_fill_holes", f"""WITH RECURSIVE {cells_sql(RES)}, {CLASS_SQL}, mask AS (SELECT survey_id, i, j FROM cls WHERE h > 8.5), gap AS (SELECT survey_id, i, j FROM cls ANTI JOIN mask USING (survey_id, i, j)), ends AS (SELECT survey_id, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM cls GROUP BY survey_id),
    open_ AS (SELECT g.survey_id, i, j FROM gap g JOIN ends e ON e.survey_id = g.survey_id WHERE i IN (i0, i1) OR j IN (j0, j1) UNION SELECT g.survey_id, g.i, g.j FROM open_ o JOIN gap g ON g.survey_id = o.survey_id AND abs(g.i - o.i) + abs(g.j - o.j) = 1)
    SELECT survey_id, i, j FROM cls ANTI JOIN open_ USING (survey_id, i, j)""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return N.fill_holes(high(spark, d, 8.5), classes(spark, d))


@query("g13_object_inventory", f"""{HIGH}, {REACH}, h AS (SELECT lab.survey_id, label, h, row_number() OVER (PARTITION BY lab.survey_id, label ORDER BY h) - 1 AS rk, count(*) OVER (PARTITION BY lab.survey_id, label) AS n FROM lab JOIN cls USING (survey_id, i, j)),
    o AS (SELECT survey_id, label, count(*) AS n, max(CASE WHEN rk = floor(0.98 * (n - 1)) THEN h END) AS height FROM h GROUP BY survey_id, label HAVING count(*) * 6.25 >= 8)
    SELECT survey_id, CAST(label AS BIGINT) AS label, n * 6.25 AS area_m2, round(height, 5) AS height_m FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY height DESC, label) AS k FROM o) WHERE k <= 400""")
def g13(spark: SparkSession, d: str) -> DataFrame:
    """Objects with area and floor-rank height; the 400 highest of each survey (a report of that many)."""
    labelled = N.components(high(spark, d)).join(classes(spark, d).select(*CELL, "h"), CELL)
    ranked = G.ranked(labelled, ["survey_id", "label"], "h")
    objects = ranked.groupBy("survey_id", "label").agg((F.count("*") * 6.25).alias("area_m2"), G.at_rank("h", 0.98).alias("height_m")).where("area_m2 >= 8")
    order = Window.partitionBy("survey_id").orderBy(F.desc("height_m"), "label")
    return objects.withColumn("k", F.row_number().over(order)).where("k <= 400").select("survey_id", "label", "area_m2", F.round("height_m", 5).alias("height_m"))


@query("g09_oriented_boxes", f"""{HIGH}, {REACH}, m AS (SELECT survey_id, label, count(*) AS n, var_pop(i) AS a, var_pop(j) AS b, covar_pop(i, j) AS c FROM lab GROUP BY survey_id, label HAVING count(*) >= 3),
    e AS (SELECT *, sqrt(greatest(0, pow(a + b, 2) / 4 - (a * b - c * c))) AS q FROM m)
    SELECT survey_id, CAST(label AS BIGINT) AS label, round(sqrt(12 * greatest(0, (a + b) / 2 + q)) * 2.5 + 2.5, 5) AS length_m, round(sqrt(12 * greatest(0, (a + b) / 2 - q)) * 2.5 + 2.5, 4) AS width_m FROM e""")
def g09(spark: SparkSession, d: str) -> DataFrame:
    """Length and width of objects from the moments of their cells, as of a filled rectangle."""
    m = N.components(high(spark, d)).groupBy("survey_id", "label").agg(F.count("*").alias("n"), F.var_pop("i").alias("a"), F.var_pop("j").alias("b"), F.covar_pop("i", "j").alias("c")).where("n >= 3")
    half = (F.col("a") + F.col("b")) / 2
    q = F.sqrt(F.greatest(F.lit(0.0), half * half - (F.col("a") * F.col("b") - F.col("c") * F.col("c"))))
    side = lambda v: F.sqrt(12 * F.greatest(F.lit(0.0), v)) * RES + RES
    return m.select("survey_id", "label", F.round(side(half + q), 5).alias("length_m"), F.round(side(half - q), 4).alias("width_m"))


@query("g16_footprints")
def g16(spark: SparkSession, d: str) -> DataFrame:
    """Smallest rectangles around objects."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["j", "i"]].to_numpy(dtype=float) * RES
        corners, length, width, azimuth = K.smallest_rectangle(np.concatenate([p, p + RES, p + [0, RES], p + [RES, 0]]))
        return pd.DataFrame({"survey_id": [pdf["survey_id"].iloc[0]], "label": [pdf["label"].iloc[0]], "length_m": [length], "width_m": [width], "azimuth_deg": [azimuth], "footprint": [corners.round(3).tolist()]})

    return N.components(high(spark, d)).groupBy("survey_id", "label").applyInPandas(work, "survey_id string, label bigint, length_m double, width_m double, azimuth_deg double, footprint array<array<double>>")


@query("g14_roof_planes")
def g14(spark: SparkSession, d: str) -> DataFrame:
    """Planes of the points of each object: slope, aspect and share, largest first."""
    labelled = N.components(high(spark, d))
    objects = G.with_cell(points(spark, d), RES).join(labelled, CELL).select("survey_id", "label", "x", "y", "z")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "z", "y"])
        x, y, z = (pdf[c].to_numpy() for c in "xyz")
        found = K.sequential_planes(x, z, y, tolerance=0.5)
        rows = [(pdf["survey_id"].iloc[0], pdf["label"].iloc[0], n, float(np.degrees(np.arctan(np.hypot(f[0], f[1])))), float(np.degrees(np.arctan2(f[0], -f[1])) % 360), k / len(x)) for n, (f, k) in enumerate(found)]
        return pd.DataFrame(rows, columns=["survey_id", "label", "plane", "slope_deg", "aspect_deg", "share"])

    return objects.groupBy("survey_id", "label").applyInPandas(work, "survey_id string, label bigint, plane bigint, slope_deg double, aspect_deg double, share double")


@query("g15_roof_forms")
def g15(spark: SparkSession, d: str) -> DataFrame:
    """Roof form from shares, slopes and opposed aspects of an object's planes."""
    planes = g14(spark, d)
    p = planes.groupBy("survey_id", "label").agg(F.sort_array(F.collect_list(F.struct("share", "slope_deg", "aspect_deg")), asc=False).alias("p"))
    steep = F.filter("p", lambda x: (x["slope_deg"] > 8) & (x["share"] >= 0.1))
    flat = F.aggregate(F.filter("p", lambda x: x["slope_deg"] <= 8), F.lit(0.0), lambda a, x: a + x["share"])
    turn = F.abs(F.element_at(steep, 1)["aspect_deg"] - F.element_at(steep, 2)["aspect_deg"])
    opposed = F.when(F.size(steep) >= 2, F.least(turn, 360 - turn) >= 140).otherwise(False)
    form = F.when(flat >= 0.6, "FLAT").when(F.size(steep) == 0, "IRREGULAR").when(F.size(steep) == 1, "SHED").when((F.size(steep) == 2) & opposed, "GABLE").when((F.size(steep) >= 4) & opposed, "HIPPED").otherwise("COMPLEX")
    return p.select("survey_id", "label", F.size("p").alias("planes"), form.alias("form"))


@query("g19_object_summary", f"""{HIGH}, {REACH}, o AS (SELECT survey_id, label, count(*) * 6.25 AS area FROM lab GROUP BY survey_id, label) SELECT survey_id, CASE WHEN area < 8 THEN 'small' WHEN area < 30 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, round(sum(area), 4) AS area_m2, round(max(area), 4) AS top_m2 FROM o GROUP BY ALL""")
def g19(spark: SparkSession, d: str) -> DataFrame:
    o = N.components(high(spark, d)).groupBy("survey_id", "label").agg((F.count("*") * 6.25).alias("area"))
    size = F.when(F.col("area") < 8, "small").when(F.col("area") < 30, "medium").otherwise("large")
    return o.groupBy("survey_id", size.alias("size")).agg(F.count("*").alias("n"), F.round(F.sum("area"), 4).alias("area_m2"), F.round(F.max("area"), 4).alias("top_m2"))


SIGHT_M = 600.0
RAYS = N.ray_count(SIGHT_M, RES)
#: CTEs over cells and cls: observers above structures, rays, what is seen along them, small gaps closed.
FAN = f"""mask AS (SELECT survey_id, i, j FROM cls WHERE h > 9.35), {REACH},
    obs AS (SELECT lab.survey_id, CAST(label AS BIGINT) AS observer, (avg(lab.j) + 0.5) * 2.5 AS x, (avg(lab.i) + 0.5) * 2.5 AS z, max(zhi) + 0.3 AS eye FROM lab JOIN cls USING (survey_id, i, j) GROUP BY lab.survey_id, label HAVING count(*) * 6.25 >= 15),
    fan AS (SELECT o.*, ray, step, step * 2.5 AS d, CAST(floor((z + sin((ray + 0.5::DOUBLE) * (2 * pi() / {RAYS})) * (step * 2.5::DOUBLE)) / 2.5::DOUBLE) AS BIGINT) AS i, CAST(floor((x + cos((ray + 0.5::DOUBLE) * (2 * pi() / {RAYS})) * (step * 2.5::DOUBLE)) / 2.5::DOUBLE) AS BIGINT) AS j FROM obs o, (SELECT unnest(range(0, {RAYS})) AS ray), (SELECT unnest(range(1, 60)) AS step)),
    los AS (SELECT f.*, (zmed - eye) / d AS sg, (zmed + 1.7 - eye) / d AS st FROM fan f JOIN cells c ON c.survey_id = f.survey_id AND c.i = f.i AND c.j = f.j),
    vis0 AS (SELECT DISTINCT survey_id, observer, i, j FROM (SELECT *, max(sg) OVER (PARTITION BY survey_id, observer, ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM los) WHERE st >= coalesce(m, -1e9)),
    wide AS (SELECT DISTINCT survey_id, observer, i + a AS i, j + b AS j FROM vis0, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b)),
    closed AS (SELECT m.survey_id, m.observer, m.i, m.j FROM wide m JOIN (SELECT survey_id, observer, i + a AS i, j + b AS j FROM wide, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b)) o USING (survey_id, observer, i, j) GROUP BY ALL HAVING count(*) = 9),
    vis AS (SELECT v.survey_id, v.observer, v.i, v.j, sqrt(pow((v.j + 0.5) * 2.5 - x, 2) + pow((v.i + 0.5) * 2.5 - z, 2)) AS distance FROM (FROM vis0 UNION FROM closed) v JOIN cells c ON c.survey_id = v.survey_id AND c.i = v.i AND c.j = v.j JOIN obs o ON o.survey_id = v.survey_id AND o.observer = v.observer)"""
SIGHT = f"WITH RECURSIVE {cells_sql(RES)}, {CLASS_SQL}, {FAN}"


def observers(spark: SparkSession, d: str) -> DataFrame:
    """One observer above each structure of at least 15 square metres."""
    c = classes(spark, d).select(*CELL, "zhi")
    o = N.components(high(spark, d)).join(c, CELL).groupBy("survey_id", "label").agg(F.count("*").alias("n"), F.avg("i").alias("ci"), F.avg("j").alias("cj"), F.max("zhi").alias("top")).where(F.col("n") * 6.25 >= 15)
    return o.select("survey_id", F.col("label").alias("observer"), ((F.col("cj") + 0.5) * RES).alias("x"), ((F.col("ci") + 0.5) * RES).alias("z"), (F.col("top") + 0.3).alias("eye"))


def seen(spark: SparkSession, d: str) -> DataFrame:
    return N.viewshed(G.cells(points(spark, d), RES), "zmed", observers(spark, d), RES, SIGHT_M)


@query("f22_viewshed", f"{SIGHT} SELECT survey_id, observer, i, j, round(distance, 6) AS distance FROM vis")
def f22(spark: SparkSession, d: str) -> DataFrame:
    """Cells that each observer above a structure sees."""
    return seen(spark, d).withColumn("distance", F.round("distance", 6))


@query("i03_exposure_map", f"{SIGHT} SELECT survey_id, i, j, round(1 - exp(sum(ln(1 - 0.95 * pow(2.0, -pow(distance / 350.0, 2))))), 6) AS exposure, count(*) AS observers FROM vis GROUP BY ALL")
def i03(spark: SparkSession, d: str) -> DataFrame:
    return N.exposure(seen(spark, d)).select(*CELL, F.round("exposure", 6).alias("exposure"), "observers")


@query("i02_concealment", f"""{C}, near_ AS (SELECT DISTINCT survey_id, i + a AS i, j + b AS j FROM mask, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b))
    SELECT c.survey_id, c.i, c.j, CASE WHEN n.i IS NOT NULL THEN 0.35 WHEN c.cls = 'low_vegetation' AND c.h >= 0.8 THEN 0.6 ELSE 1.0 END AS factor FROM cls c LEFT JOIN near_ n ON n.survey_id = c.survey_id AND n.i = c.i AND n.j = c.j""")
def i02(spark: SparkSession, d: str) -> DataFrame:
    near = N.dilate(mask(spark, d), 1, square=True).withColumn("near", F.lit(True))
    factor = F.when(F.col("near"), 0.35).when((F.col("cls") == "low_vegetation") & (F.col("h") >= 0.8), 0.6).otherwise(1.0)
    return classes(spark, d).join(near, CELL, "left").select(*CELL, factor.cast("double").alias("factor"))


@query("i05_ray_enclosure", f"""{C}, fan AS (SELECT s.survey_id, s.i, s.j, ray, step, CAST(floor(i + 0.5::DOUBLE + sin((ray + 0.5::DOUBLE) * (2 * pi() / 36)) * step) AS BIGINT) AS ti, CAST(floor(j + 0.5::DOUBLE + cos((ray + 0.5::DOUBLE) * (2 * pi() / 36)) * step) AS BIGINT) AS tj FROM cells s, (SELECT unnest(range(0, 36)) AS ray), (SELECT unnest(range(2, 21)) AS step)),
    hit AS (SELECT f.survey_id, f.i, f.j, ray, min(step) AS first FROM fan f JOIN cls m ON m.survey_id = f.survey_id AND m.i = ti AND m.j = tj AND m.cls IN ('tree', 'building') GROUP BY ALL),
    s AS (SELECT s.survey_id, s.i, s.j, count(ray) / 36.0 AS enclosure, {', '.join(f'count(*) FILTER (WHERE ray >= {9 * k} AND ray < {9 * k + 9}) / 9.0 AS q{k + 1}' for k in range(4))}, avg(first) * 2.5 AS first_m FROM cells s LEFT JOIN hit h ON h.survey_id = s.survey_id AND h.i = s.i AND h.j = s.j GROUP BY ALL)
    SELECT survey_id, i, j, round(enclosure, 6) AS enclosure, {', '.join(f'round(q{k}, 6) AS q{k}' for k in (1, 2, 3, 4))}, round(least(q1, q2, q3, q4), 6) AS weakest, round(first_m, 6) AS first_m FROM s""")
def i05(spark: SparkSession, d: str) -> DataFrame:
    """How much of the horizon around each cell is closed by trees or structures from 5 to 50 m, by quadrant."""
    c = classes(spark, d)
    found = N.enclosure(c.select(*CELL), c.where("cls IN ('tree', 'building')").select(*CELL), 2, 20)
    quarters = [f"q{k}" for k in (1, 2, 3, 4)]
    return found.select(*CELL, F.round("enclosure", 6).alias("enclosure"), *[F.round(q, 6).alias(q) for q in quarters], F.round(F.least(*quarters), 6).alias("weakest"), F.round(F.col("first") * RES, 6).alias("first_m"))


@query("i07_topographic_position", f"WITH {dense_sql(RES)} SELECT c.survey_id, c.i, c.j, round(c.zlo - {square_sql('avg(o.zlo)', 6)}, 5) AS tpi FROM grid c WHERE c.zlo IS NOT NULL")
def i07(spark: SparkSession, d: str) -> DataFrame:
    out = G.box_mean(raster(spark, d), "zlo", 6, "mean").where("zlo IS NOT NULL")
    return out.select(*CELL, F.round(F.col("zlo") - F.col("mean"), 5).alias("tpi"))


COST = "CASE cls WHEN 'ground' THEN 1.0 WHEN 'low_vegetation' THEN 1.2 WHEN 'tree' THEN 1.5 END"


@query("i08_terrain_cost", f"WITH {cells_sql(RES)}, {CLASS_SQL} SELECT survey_id, i, j, CAST({COST} AS DOUBLE) AS factor FROM cls")
def i08(spark: SparkSession, d: str) -> DataFrame:
    """Effort factor of each cell; null is impassable."""
    return classes(spark, d).select(*CELL, F.expr(COST).cast("double").alias("factor"))


STEP_SQL = f"""WITH {cells_sql(RES)}, {CLASS_SQL}, f AS (SELECT survey_id, i, j, zlo, {COST} AS k FROM cls WHERE cls <> 'building'),
    e AS (SELECT a.survey_id, a.i, a.j, b.i - a.i AS di, b.j - a.j AS dj, b.k, b.zlo - a.zlo AS dz, sqrt(pow(b.i - a.i, 2) + pow(b.j - a.j, 2)) * 2.5 AS dh FROM f a JOIN f b ON a.survey_id = b.survey_id AND abs(b.i - a.i) <= 1 AND abs(b.j - a.j) <= 1 AND (a.i <> b.i OR a.j <> b.j)),
    t AS (SELECT *, sqrt(dh * dh + dz * dz) / (6.0 * exp(-3.5 * abs(dz / dh + 0.05)) / 3.6) AS s FROM e)"""


@query("i09_directed_edge_cost", f"{STEP_SQL} SELECT survey_id, i, j, CAST(di AS BIGINT) AS di, CAST(dj AS BIGINT) AS dj, round(s * k + 0.35 * s * pow(degrees(atan(abs(dz / dh))) / 10, 2), 4) AS cost FROM t")
def i09(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of a step to each passable neighbour: walking speed by grade, cover, steepness."""
    f = classes(spark, d).where("cls <> 'building'").select(*CELL, "zlo", F.expr(COST).alias("k"))
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    a = f.withColumn("o", F.explode(around)).select("survey_id", F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("zlo").alias("z0"), (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), F.col("o.di").cast("bigint").alias("di"), F.col("o.dj").cast("bigint").alias("dj"))
    e = a.join(f, CELL).withColumn("dz", F.col("zlo") - F.col("z0")).withColumn("dh", F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double")) * RES)
    grade = F.col("dz") / F.col("dh")
    s = F.sqrt(F.col("dh") * F.col("dh") + F.col("dz") * F.col("dz")) / (6.0 * F.exp(-3.5 * F.abs(grade + 0.05)) / 3.6)
    cost = s * F.col("k") + 0.35 * s * F.pow(F.degrees(F.atan(F.abs(grade))) / 10, 2)
    return e.select("survey_id", F.col("ai").alias("i"), F.col("aj").alias("j"), "di", "dj", F.round(cost, 4).alias("cost"))


@query("i10_snap_to_passable", f"""WITH {cells_sql(RES)}, {CLASS_SQL}, p AS (SELECT survey_id, i, j FROM cls WHERE cls <> 'building'), q AS (SELECT survey_id, i, j FROM cls WHERE cls = 'building')
    SELECT q.survey_id, q.i, q.j, round(sqrt(min(pow(p.i - q.i, 2) + pow(p.j - q.j, 2))) * 2.5, 5) AS snap_m FROM q JOIN p ON p.survey_id = q.survey_id GROUP BY ALL""")
def i10(spark: SparkSession, d: str) -> DataFrame:
    """Way from each blocked cell to the nearest passable one, however far."""
    c = classes(spark, d)
    found = N.distance_to(c.where("cls = 'building'").select(*CELL), c.where("cls <> 'building'").select(*CELL)).where("distance IS NOT NULL")
    return found.select(*CELL, F.round(F.col("distance") * RES, 5).alias("snap_m"))


@query("i11_least_cost_routes")
def i11(spark: SparkSession, d: str) -> DataFrame:
    """Ways across each survey in three modes, with length, time, climb and mean exposure.

    The grid of a route is bounded: surveys above ``most`` cells are coarsened first, like the raster of
    any report; one survey and mode is one task.
    """
    most = 450_000
    c = classes(spark, d).select(*CELL, "zlo", F.expr(COST).alias("k"))
    expo = N.exposure(seen(spark, d)).select(*CELL, "exposure")
    table = c.join(expo, CELL, "left").withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))
    n = c.groupBy("survey_id").agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*") / most))).alias("f"))
    table = table.join(n, "survey_id").groupBy("survey_id", "f", F.floor(F.col("i") / F.col("f")).alias("i"), F.floor(F.col("j") / F.col("f")).alias("j")).agg(F.avg("zlo").alias("zlo"), F.max("k").alias("k"), F.avg("exposure").alias("exposure"))
    modes = table.withColumn("mode", F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.lit(a).alias("w_exp"), F.lit(b).alias("w_slope")) for m, a, b in (("covert", 14.0, 0.6), ("balanced", 4.0, 0.35), ("fastest", 0.0, 0.1))])))
    modes = modes.select("*", F.col("mode.name").alias("name"), F.col("mode.w_exp").alias("w_exp"), F.col("mode.w_slope").alias("w_slope")).drop("mode")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        shape = (int(i.max()) + 1, int(j.max()) + 1)
        z, k, e = (np.full(shape, np.nan) for _ in range(3))
        for a, col in ((z, "zlo"), (k, "k"), (e, "exposure")):
            a[i, j] = pdf[col].to_numpy(dtype=float)
        ok = ~np.isnan(k) & ~np.isnan(z)
        res, we, ws = RES * int(pdf["f"].iloc[0]), float(pdf["w_exp"].iloc[0]), float(pdf["w_slope"].iloc[0])

        def seconds(a: int, b: int, c_: int, d_: int) -> tuple[float, float, float]:
            dh, dz = np.hypot(c_ - a, d_ - b) * res, z[c_, d_] - z[a, b]
            grade = dz / dh
            return float(np.sqrt(dh * dh + dz * dz) / (6.0 * np.exp(-3.5 * abs(grade + 0.05)) / 3.6)), float(np.degrees(np.arctan(abs(grade)))), float(dz)

        def cost(a: int, b: int, c_: int, d_: int) -> float:
            s, deg, _ = seconds(a, b, c_, d_)
            return s * k[c_, d_] * (1 + we * e[c_, d_]) + ws * s * (deg / 10) ** 2

        free = np.argwhere(ok)
        if not len(free):
            return pd.DataFrame(columns=["survey_id", "mode", "cost", "cells", "time_s", "climb_m", "exposure", "line"])
        start = tuple(free[np.abs(free - [0, 0]).sum(1).argmin()])
        goal = tuple(free[np.abs(free - np.array(shape)).sum(1).argmin()])
        total, way = K.cheapest_way(cost, ok, start, goal)
        steps = [seconds(*p, *q) for p, q in zip(way, way[1:])]
        line = np.array(way, dtype=float)[:, ::-1] * res if way else np.zeros((0, 2))
        kept = line[K.simplify(line, 0.6 * res)].tolist()
        time = sum(s for s, _, _ in steps)
        mean = sum(s * (e[p] + e[q]) / 2 for (s, _, _), p, q in zip(steps, way, way[1:])) / max(time, 1e-9)
        return pd.DataFrame({"survey_id": [pdf["survey_id"].iloc[0]], "mode": [pdf["name"].iloc[0]], "cost": [total], "cells": [len(way)], "time_s": [time], "climb_m": [sum(max(dz, 0) for _, _, dz in steps)], "exposure": [float(mean)], "line": [kept]})

    return modes.groupBy("survey_id", "name").applyInPandas(work, "survey_id string, mode string, cost double, cells bigint, time_s double, climb_m double, exposure double, line array<array<double>>")


@query("e12_bare_earth")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return N.bare_earth(G.object_cells(raster(spark, d), "zlo", RES))


@query("f11_skeleton")
def f11(spark: SparkSession, d: str) -> DataFrame:
    """Skeletons of the tree mask, thinned in tiles with a halo."""
    m = mask(spark, d).withColumn("m", F.lit(1.0))
    out = N.tile_kernel(m, ["m"], 256, 32, lambda a, p, i0, j0: {"skeleton": K.thin(a["m"] == 1.0)}, "survey_id string, i bigint, j bigint, skeleton boolean")
    return out.where("skeleton").select(*CELL)


@query("f13_longest_ways")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Longest ways of the skeleton of each component, simplified."""
    labelled = N.components(high(spark, d, 8.8))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        g = np.zeros((int(i.max() - i.min()) + 1, int(j.max() - j.min()) + 1), dtype=bool)
        g[i - i.min(), j - j.min()] = True
        ways = K.longest_ways(K.thin(g))
        rows = []
        for n, way in enumerate(ways):
            line = (np.array(way, dtype=float) + [i.min(), j.min()])[:, ::-1] * RES
            rows.append((pdf["survey_id"].iloc[0], pdf["label"].iloc[0], n, float(np.hypot(*np.diff(line, axis=0).T).sum()), line[K.simplify(line, 0.6 * RES)].tolist()))
        return pd.DataFrame(rows, columns=["survey_id", "label", "way", "length_m", "line"])

    return labelled.groupBy("survey_id", "label").applyInPandas(work, "survey_id string, label bigint, way bigint, length_m double, line array<array<double>>")


def ramp(c, low: float, high: float):  # noqa: ANN001, ANN201
    """0 at low, 1 at high, linear between; low may be above high."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / (high - low)))


def ramp_sql(c: str, low: float, high: float) -> str:
    return f"greatest(0.0, least(1.0, ({c} - {low}) / ({high} - {low})))"


ROAD = f"""WITH {cells_sql(RES)}, v AS (SELECT *, zmed - zlo AS nd, (2 * g - r - b) / (r + g + b + 1e-6) AS exg, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1e-6) ELSE 0 END AS sat, greatest(r, g, b) / 255.0 AS val FROM cells),
    l AS (SELECT survey_id, i, j, nd, {ramp_sql('nd', 0.45, 0.15)} * {ramp_sql('exg', 0.40, 0.03)} * {ramp_sql('sat', 0.92, 0.12)} * {ramp_sql('val', 0.12, 0.2)} AS likelihood FROM v)"""


def road(spark: SparkSession, d: str) -> DataFrame:
    c = G.colour_indices(G.cells(points(spark, d), RES)).withColumn("nd", F.col("zmed") - F.col("zlo"))
    product = ramp(F.col("nd"), 0.45, 0.15) * ramp(F.col("exg"), 0.40, 0.03) * ramp(F.col("sat"), 0.92, 0.12) * ramp(F.col("val"), 0.12, 0.2)
    return c.select(*CELL, "nd", product.alias("likelihood"))


@query("h01_road_likelihood", f"{ROAD} SELECT survey_id, i, j, round(likelihood, 6) AS likelihood FROM l")
def h01(spark: SparkSession, d: str) -> DataFrame:
    return road(spark, d).select(*CELL, F.round("likelihood", 6).alias("likelihood"))


@query("h02_road_segments")
def h02(spark: SparkSession, d: str) -> DataFrame:
    """Cells grown from strong road likelihood, as components with area."""
    r = road(spark, d)
    grown = N.grow(r.where("likelihood > 0.45"), r.where("likelihood > 0.1"))
    return N.components(N.close_mask(grown, 1)).groupBy("survey_id", "label").agg((F.count("*") * RES * RES).alias("area_m2"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


DEFECT = """CASE WHEN diameter_mm > 750 THEN CASE WHEN depth_mm <= 25 THEN 'MEDIUM' ELSE 'HIGH' END
    WHEN depth_mm <= 25 THEN CASE WHEN diameter_mm <= 450 THEN 'LOW' ELSE 'MEDIUM' END
    WHEN depth_mm <= 50 THEN CASE WHEN diameter_mm <= 200 THEN 'LOW' WHEN diameter_mm <= 450 THEN 'MEDIUM' ELSE 'HIGH' END
    ELSE CASE WHEN diameter_mm <= 450 THEN 'MEDIUM' ELSE 'HIGH' END END"""
HOLES = "holes AS (SELECT p_partkey AS hole, p_size AS depth_mm, p_retailprice % 900 AS diameter_mm, p_brand AS road FROM part)"


def holes(spark: SparkSession, d: str) -> DataFrame:
    from terravane.session import read

    return read(spark, d, "part").select(F.col("p_partkey").alias("hole"), F.col("p_size").alias("depth_mm"), (F.col("p_retailprice") % 900).alias("diameter_mm"), F.col("p_brand").alias("road"))


@query("h10_defect_severity", f"WITH {HOLES} SELECT hole, {DEFECT} AS severity FROM holes")
def h10(spark: SparkSession, d: str) -> DataFrame:
    """Severity of a surface defect by depth and mean diameter."""
    depth, across = F.col("depth_mm"), F.col("diameter_mm")
    shallow = F.when(across <= 450, "LOW").otherwise("MEDIUM")
    middle = F.when(across <= 200, "LOW").when(across <= 450, "MEDIUM").otherwise("HIGH")
    deep = F.when(across <= 450, "MEDIUM").otherwise("HIGH")
    wide = F.when(depth <= 25, "MEDIUM").otherwise("HIGH")
    severity = F.when(across > 750, wide).when(depth <= 25, shallow).when(depth <= 50, middle).otherwise(deep)
    return holes(spark, d).select("hole", severity.alias("severity"))


@query("h11_condition_score", f"""WITH {HOLES}, s AS (SELECT road, {DEFECT} AS severity FROM holes), w AS (SELECT road, sum(CASE severity WHEN 'LOW' THEN 4 WHEN 'MEDIUM' THEN 10 ELSE 22 END) / 50.0 AS x FROM s GROUP BY road)
    SELECT road, round(100 - 60 * (1 - exp(-x / 40.0)), 5) AS score, CASE WHEN 100 - 60 * (1 - exp(-x / 40.0)) < 55 THEN 'CRITICAL' WHEN 100 - 60 * (1 - exp(-x / 40.0)) < 80 THEN 'CAUTION' ELSE 'PASSABLE' END AS status FROM w""")
def h11(spark: SparkSession, d: str) -> DataFrame:
    """Deducts for each defect per area, saturating, and the status they make."""
    graded = holes(spark, d).join(h10(spark, d), "hole")
    points_ = F.when(F.col("severity") == "LOW", 4).when(F.col("severity") == "MEDIUM", 10).otherwise(22)
    score = 100 - 60 * (1 - F.exp(-F.col("x") / 40.0))
    status = F.when(score < 55, "CRITICAL").when(score < 80, "CAUTION").otherwise("PASSABLE")
    return graded.groupBy("road").agg((F.sum(points_) / 50.0).alias("x")).select("road", F.round(score, 5).alias("score"), status.alias("status"))


@query("h08_local_noise", f"""WITH {cells_sql(RES)}, m AS (SELECT survey_id, i // 4 AS bi, j // 4 AS bj, quantile_cont(zmed, 0.5) AS m FROM cells GROUP BY ALL) SELECT c.survey_id, bi, bj, round(greatest(0.05, 1.4826 * quantile_cont(abs(zmed - m), 0.5)), 5) AS sigma FROM cells c JOIN m ON m.survey_id = c.survey_id AND bi = i // 4 AND bj = j // 4 GROUP BY ALL""")
def h08(spark: SparkSession, d: str) -> DataFrame:
    c = G.cells(points(spark, d), RES).withColumns({"bi": F.floor(F.col("i") / 4), "bj": F.floor(F.col("j") / 4)})
    return G.mad_sigma(c, ["survey_id", "bi", "bj"], "zmed").select("survey_id", "bi", "bj", F.round(F.greatest(F.lit(0.05), F.col("sigma")), 5).alias("sigma"))


@query("h09_surface_defects")
def h09(spark: SparkSession, d: str) -> DataFrame:
    """Dips below the smoothed surface by more than three local sigmas, as components with depth."""
    c = G.cells(points(spark, d), RES)
    s = N.smooth(c.select(*CELL, "zlo"), "zlo", 2.0, "ref").withColumn("r", F.col("zlo") - F.col("ref"))
    sigma = G.mad_sigma(s, ["survey_id"], "r")
    dips = s.join(sigma, "survey_id").where(F.col("r") < -F.greatest(3 * F.col("sigma"), F.lit(0.02)))
    labelled = N.components(dips).join(s.select(*CELL, "r"), CELL)
    return labelled.groupBy("survey_id", "label").agg(F.count("*").alias("cells"), F.percentile(-F.col("r"), F.lit(0.95)).alias("depth_m"))


PAIR = f"""WITH {dense_sql(RES)}, a AS (SELECT * FROM grid WHERE survey_id = 'day1'), b AS (SELECT * FROM grid WHERE survey_id = 'day2'),
    s AS (SELECT c.i, c.j, (SELECT max(o.zhi) FROM a o WHERE abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1) AS top, (SELECT min(o.zhi) FROM a o WHERE abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1) AS low FROM a c),
    bt AS (SELECT c.i, c.j, (SELECT max(o.zhi) FROM b o WHERE abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1) AS top FROM b c),
    p AS (SELECT a.i, a.j, b.zhi - CASE WHEN s.top - s.low > 0.5 THEN s.top ELSE a.zhi END AS gain, CASE WHEN s.top - s.low > 0.5 THEN a.zhi - bt.top ELSE greatest(a.zhi - b.zhi, a.zmed - b.zmed) END AS loss, a.zmed AS za, b.zmed AS zb
      FROM a JOIN b USING (i, j) JOIN s USING (i, j) JOIN bt USING (i, j))"""


def day_pair(spark: SparkSession, d: str) -> DataFrame:
    """Cells of both days with gain and loss; at steps of the first day its highest neighbour counts."""
    g = G.box(raster(spark, d), 1, top=("zhi", "max"), low=("zhi", "min"))
    day = lambda k: g.where(F.col("survey_id") == k)
    a = day("day1").select("i", "j", F.col("zhi").alias("a"), F.col("zmed").alias("za"), (F.col("top") - F.col("low") > 0.5).alias("step"), F.col("top").alias("ta"))
    b = day("day2").select("i", "j", F.col("zhi").alias("b"), F.col("zmed").alias("zb"), F.col("top").alias("tb"))
    gain = F.col("b") - F.when(F.col("step"), F.col("ta")).otherwise(F.col("a"))
    loss = F.when(F.col("step"), F.col("a") - F.col("tb")).otherwise(F.greatest(F.col("a") - F.col("b"), F.col("za") - F.col("zb")))
    return a.join(b, ["i", "j"]).select("i", "j", gain.alias("gain"), loss.alias("loss"), "za", "zb")


@query("j05_gain_and_loss", f"{PAIR} SELECT i, j, round(gain, 5) AS gain, round(loss, 5) AS loss FROM p")
def j05(spark: SparkSession, d: str) -> DataFrame:
    return day_pair(spark, d).select("i", "j", F.round("gain", 5).alias("gain"), F.round("loss", 5).alias("loss"))


@query("j06_detection_level", f"{PAIR}, m AS (SELECT quantile_cont(zb - za, 0.5) AS m FROM p), q AS (SELECT m, 1.4826 * quantile_cont(abs(zb - za - m), 0.5) AS sigma FROM p, m GROUP BY m) SELECT round(m, 5) AS shift_m, round(sigma, 5) AS sigma_m, round(1.96 * sqrt(sigma * sigma + 0.0225), 5) AS level_m FROM q")
def j06(spark: SparkSession, d: str) -> DataFrame:
    """Vertical shift of the days, its scatter and the smallest change that counts."""
    p = day_pair(spark, d).withColumn("d", F.col("zb") - F.col("za")).withColumn("all", F.lit(1))
    s = G.quantile(p, ["all"], "d", 0.5, "m").join(G.mad_sigma(p, ["all"], "d"), "all")
    return s.select(F.round("m", 5).alias("shift_m"), F.round("sigma", 5).alias("sigma_m"), F.round(1.96 * F.sqrt(F.col("sigma") * F.col("sigma") + 0.0225), 5).alias("level_m"))


@query("j07_change_objects", f"""{PAIR.replace('WITH ', 'WITH RECURSIVE ', 1)}, mask AS (SELECT CASE WHEN gain > 0.6 THEN 'gain' ELSE 'loss' END AS survey_id, i, j FROM p WHERE gain > 0.6 OR loss > 0.6), {REACH}
    SELECT lab.survey_id AS kind, CAST(label AS BIGINT) AS label, count(*) * 6.25 AS area_m2, round(max(CASE lab.survey_id WHEN 'gain' THEN gain ELSE loss END), 5) AS height_m FROM lab JOIN p USING (i, j) GROUP BY ALL HAVING count(*) * 6.25 >= 12""")
def j07(spark: SparkSession, d: str) -> DataFrame:
    """Connected gains and losses with area and largest height."""
    p = day_pair(spark, d)
    kind = F.when(F.col("gain") > 0.6, "gain").otherwise("loss")
    changed = p.where("gain > 0.6 OR loss > 0.6").select(kind.alias("survey_id"), "i", "j", F.when(F.col("gain") > 0.6, F.col("gain")).otherwise(F.col("loss")).alias("h"))
    labelled = N.components(changed).join(changed, CELL)
    return labelled.groupBy(F.col("survey_id").alias("kind"), "label").agg((F.count("*") * 6.25).alias("area_m2"), F.round(F.max("h"), 5).alias("height_m")).where("area_m2 >= 12")


@query("j09_alert_order", f"""{PAIR}, m AS (SELECT CASE WHEN gain > 0.9 THEN 'gain' ELSE 'loss' END AS kind, i, j, greatest(gain, loss) AS h FROM p WHERE gain > 0.9 OR loss > 0.9) SELECT kind, i, j, 'CHG-' || printf('%04d', row_number() OVER (ORDER BY CASE kind WHEN 'gain' THEN 0 ELSE 1 END, round(h, 6) DESC, i, j)) AS id FROM m""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    """Alerts in order of severity and size, numbered."""
    p = day_pair(spark, d).where("gain > 0.9 OR loss > 0.9")
    kind = F.when(F.col("gain") > 0.9, "gain").otherwise("loss")
    rows = p.select(kind.alias("kind"), "i", "j", F.round(F.greatest("gain", "loss"), 6).alias("h"))
    order = [F.when(F.col("kind") == "gain", 0).otherwise(1), F.desc("h"), F.col("i"), F.col("j")]
    return G.numbered(rows, order, "no").select("kind", "i", "j", F.format_string("CHG-%04d", "no").alias("id"))


@query("j03_tile_registration")
def j03(spark: SparkSession, d: str) -> DataFrame:
    """Shift of the second day against the first in each tile, from the correlation of their surfaces."""
    g = raster(spark, d).select("survey_id", "i", "j", "zmed")
    pair = g.where("survey_id = 'day1'").select("i", "j", F.col("zmed").alias("a")).join(g.where("survey_id = 'day2'").select("i", "j", F.col("zmed").alias("b")), ["i", "j"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        shape = (int(i.max() - i.min()) + 1, int(j.max() - j.min()) + 1)
        a, b = np.full(shape, np.nan), np.full(shape, np.nan)
        a[i - i.min(), j - j.min()], b[i - i.min(), j - j.min()] = pdf["a"], pdf["b"]
        if np.isnan(a).all() or np.isnan(b).all():
            return pd.DataFrame(columns=["ti", "tj", "di", "dj", "sharpness"])
        di, dj, sharp = K.shift_between(a, b, 4)
        return pd.DataFrame({"ti": [pdf["ti"].iloc[0]], "tj": [pdf["tj"].iloc[0]], "di": [di], "dj": [dj], "sharpness": [sharp]})

    tiles = pair.withColumns({"ti": F.floor(F.col("i") / 20), "tj": F.floor(F.col("j") / 20)})
    return tiles.groupBy("ti", "tj").applyInPandas(work, "ti bigint, tj bigint, di bigint, dj bigint, sharpness double")


@query("j04_vertical_fit")
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Plane of the height difference of the days, fitted robustly from one aggregated cell table."""
    p = day_pair(spark, d).where("abs(zb - za) < 2").select(((F.col("j") + 0.5) * RES).alias("x"), ((F.col("i") + 0.5) * RES).alias("z"), (F.col("zb") - F.col("za")).alias("d"), F.lit(1).alias("all"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        fit, sigma = K.robust_plane(*(pdf[c].to_numpy() for c in ("x", "z", "d")))
        return pd.DataFrame({"a": [fit[0]], "b": [fit[1]], "c": [fit[2]], "sigma_m": [sigma], "cells": [len(pdf)]})

    blocks = p.groupBy("all", F.floor(F.col("x") / 10), F.floor(F.col("z") / 10)).agg(F.avg("x").alias("x"), F.avg("z").alias("z"), F.percentile("d", F.lit(0.5)).alias("d"))
    return blocks.groupBy("all").applyInPandas(work, "a double, b double, c double, sigma_m double, cells bigint")
