"""Queries over objects on a surface: picking, crowns, bases, outlines, buildings, water, meshes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import grid as G
from terravane.operators import neighbour as N
from terravane.operators import structures as S
from terravane.plans.fixtures import cells_sql, dense_sql, points
from terravane.plans.rasters import HIGH, REACH, high
from terravane.plans.terrain import CLASS_SQL, RES, classes, raster
from terravane.session import cut_lineage

QUERIES, ORACLE = {}, {}
CELL = G.CELL


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Labelled cells of the high objects with their layers."""
    return cut_lineage(N.components(high(spark, d)).join(classes(spark, d), CELL))


CLICKS = "clicks AS (SELECT s.survey_id, k, 3.0 + 8 * k AS x, 97.0 - 8 * k AS z FROM (SELECT unnest(['day1', 'day2']) AS survey_id) s, (SELECT unnest(range(0, 12)) AS k))"


@query("g01_object_at_click", f"""{HIGH}, {REACH}, {CLICKS}, n AS (SELECT c.survey_id, c.k, min(row(sqrt(pow((l.j + 0.5) * 2.5 - c.x, 2) + pow((l.i + 0.5) * 2.5 - c.z, 2)), l.i, l.j, l.label)) AS m FROM clicks c JOIN lab l ON l.survey_id = c.survey_id WHERE sqrt(pow((l.j + 0.5) * 2.5 - c.x, 2) + pow((l.i + 0.5) * 2.5 - c.z, 2)) <= 4.0 GROUP BY ALL)
    SELECT n.survey_id, CAST(n.k AS BIGINT) AS k, CAST(m[4] AS BIGINT) AS label, count(*) AS cells FROM n JOIN lab ON lab.survey_id = n.survey_id AND lab.label = m[4] GROUP BY ALL""")
def g01(spark: SparkSession, d: str) -> DataFrame:
    """The object nearest to a click, at most 4 m away, and its size."""
    o = objects(spark, d)
    clicks = o.select("survey_id").distinct().withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")))
    clicks = clicks.withColumn("x", 3.0 + 8 * F.col("pid")).withColumn("z", 97.0 - 8 * F.col("pid"))
    return S.picked(clicks, o, RES, 4.0).select("survey_id", F.col("pid").alias("k"), "label", "cells")


CROWNS = f"""{HIGH}, g AS (SELECT m.survey_id, m.i, m.j, zhi FROM mask m JOIN cells USING (survey_id, i, j)), top AS (SELECT a.survey_id, a.i, a.j FROM g a JOIN g b ON b.survey_id = a.survey_id AND abs(b.i - a.i) <= 1 AND abs(b.j - a.j) <= 1 GROUP BY a.survey_id, a.i, a.j, a.zhi HAVING a.zhi >= max(b.zhi)),
    own AS (SELECT g.survey_id, g.i, g.j, min(row(CAST(pow(t.i - g.i, 2) + pow(t.j - g.j, 2) AS BIGINT), t.i, t.j)) AS m FROM g JOIN top t ON t.survey_id = g.survey_id GROUP BY ALL)"""


@query("g02_crowns", f"{CROWNS} SELECT survey_id, m[2] AS top_i, m[3] AS top_j, count(*) AS cells FROM own GROUP BY ALL")
def g02(spark: SparkSession, d: str) -> DataFrame:
    """High cells divided among the local maxima of the surface, each to the nearest."""
    g = high(spark, d).join(classes(spark, d).select(*CELL, "zhi"), CELL)
    return S.crowns(g, "zhi").groupBy("survey_id", F.col("near_i").alias("top_i"), F.col("near_j").alias("top_j")).agg(F.count("*").alias("cells"))


@query("g07_base_ring", f"""{HIGH}, {REACH}, free AS (SELECT c.survey_id, c.i, c.j, c.zlo FROM cls c ANTI JOIN mask USING (survey_id, i, j)), ring AS (SELECT f.survey_id, f.i, f.j, f.zlo, min(row(CAST(pow(l.i - f.i, 2) + pow(l.j - f.j, 2) AS BIGINT), l.i, l.j, l.label)) AS m FROM free f JOIN lab l ON l.survey_id = f.survey_id GROUP BY ALL)
    SELECT survey_id, CAST(m[4] AS BIGINT) AS label, count(*) AS cells, round(quantile_cont(zlo, 0.5), 5) AS base_m FROM ring WHERE m[1] <= 6 GROUP BY ALL HAVING count(*) >= 3""")
def g07(spark: SparkSession, d: str) -> DataFrame:
    """Ground level around each object: median of the free cells within 6 m whose nearest object it is."""
    free = classes(spark, d).select(*CELL, "zlo").join(high(spark, d), CELL, "left_anti")
    return S.base_ring(free, objects(spark, d), "zlo", 6).select("survey_id", "label", "cells", F.round("base_m", 5).alias("base_m"))


@query("g10_outlines", f"""{HIGH}, {REACH}, e AS (SELECT l.survey_id, l.label, l.i, l.j, 4 - count(o.i) AS open FROM lab l LEFT JOIN lab o ON o.survey_id = l.survey_id AND o.label = l.label AND abs(o.i - l.i) + abs(o.j - l.j) = 1 GROUP BY ALL)
    SELECT survey_id, CAST(label AS BIGINT) AS label, CAST(count(*) FILTER (WHERE open > 0) AS BIGINT) AS border_cells, CAST(sum(open) * 2.5 AS DOUBLE) AS perimeter_m FROM e GROUP BY ALL""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Border cells and length of the outline of each object, holes included."""
    b = S.open_edges(objects(spark, d))
    return b.groupBy("survey_id", "label").agg(F.count_if(F.col("open") > 0).alias("border_cells"), (F.sum("open") * RES).alias("perimeter_m"))


@query("g18_buildings", f"""{HIGH}, {REACH}, r AS (SELECT lab.survey_id, label, i, j, h, zlo, row_number() OVER (PARTITION BY lab.survey_id, label ORDER BY h) - 1 AS rk, count(*) OVER (PARTITION BY lab.survey_id, label) AS n FROM lab JOIN cls USING (survey_id, i, j)),
    o AS (SELECT survey_id, label, count(*) * 6.25 AS area, max(CASE WHEN rk = floor(0.95 * (n - 1)) THEN h END) AS height, sum(h) * 6.25 AS volume, avg(i) AS ci, avg(j) AS cj FROM r GROUP BY survey_id, label)
    SELECT survey_id, CAST(label AS BIGINT) AS label, CAST(area AS DOUBLE) AS area_m2, round(height, 5) AS height_m, round(volume, 3) AS volume_m3, CAST(greatest(1, round(height / 3)) AS BIGINT) AS storeys, round((cj + 0.5) * 2.5, 5) AS x, round((ci + 0.5) * 2.5, 5) AS z FROM o WHERE area >= 12""")
def g18(spark: SparkSession, d: str) -> DataFrame:
    """Buildings of at least 12 square metres: height, volume, storeys, place."""
    b = S.buildings(objects(spark, d), "h", RES)
    return b.select("survey_id", "label", "area_m2", F.round("height_m", 5).alias("height_m"), F.round("volume_m3", 3).alias("volume_m3"), "storeys", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"))


@query("e18_no_return", f"""WITH RECURSIVE {dense_sql(RES)}, hole AS (SELECT survey_id, i, j FROM grid WHERE coalesce(n, 0) < 16), er AS (SELECT m.survey_id, m.i, m.j FROM hole m JOIN hole o ON o.survey_id = m.survey_id AND abs(o.i - m.i) + abs(o.j - m.j) <= 1 GROUP BY ALL HAVING count(*) = 5),
    mask AS (SELECT DISTINCT survey_id, i + a AS i, j + b AS j FROM er, (SELECT unnest([0, 0, 0, 1, -1]) AS a, unnest([0, 1, -1, 0, 0]) AS b)), {REACH} SELECT survey_id, CAST(label AS BIGINT) AS label, count(*) * 6.25 AS area_m2 FROM lab GROUP BY ALL HAVING count(*) * 6.25 >= 25""")
def e18(spark: SparkSession, d: str) -> DataFrame:
    """Areas of at least 25 square metres with few or no returns, opened by a disk: water and the like."""
    g = raster(spark, d).where(F.coalesce("n", F.lit(0)) < 16).select(*CELL)
    return N.components(N.open_mask(g, 1, square=False)).groupBy("survey_id", "label").agg((F.count("*") * 6.25).alias("area_m2")).where("area_m2 >= 25")


MESH = f"""WITH {cells_sql(RES)}, sq AS (SELECT a.survey_id, a.i, a.j, a.zmed AS z00, b.zmed AS z01, c.zmed AS z10, e.zmed AS z11 FROM cells a JOIN cells b ON b.survey_id = a.survey_id AND b.i = a.i AND b.j = a.j + 1 JOIN cells c ON c.survey_id = a.survey_id AND c.i = a.i + 1 AND c.j = a.j JOIN cells e ON e.survey_id = a.survey_id AND e.i = a.i + 1 AND e.j = a.j + 1),
    face AS (SELECT survey_id, i, j, 0 AS k, [{{'i': i, 'j': j}}, {{'i': i + 1, 'j': j}}, {{'i': i, 'j': j + 1}}] AS v, -(z01 - z00) / 2.5 AS nx, -(z10 - z00) / 2.5 AS nz FROM sq UNION ALL SELECT survey_id, i, j, 1, [{{'i': i + 1, 'j': j}}, {{'i': i + 1, 'j': j + 1}}, {{'i': i, 'j': j + 1}}], -(z11 - z10) / 2.5, -(z11 - z01) / 2.5 FROM sq)"""


@query("l05_vertex_normals", f"""{MESH}, e AS (SELECT survey_id, unnest(v) AS p, nx, nz FROM face), s AS (SELECT survey_id, p.i AS i, p.j AS j, sum(nx) AS x, count(*) AS y, sum(nz) AS z FROM e GROUP BY ALL)
    SELECT survey_id, i, j, round(x / sqrt(x * x + y * y + z * z), 5) AS nx, round(y / sqrt(x * x + y * y + z * z), 5) AS ny, round(z / sqrt(x * x + y * y + z * z), 5) AS nz FROM s""")
def l05(spark: SparkSession, d: str) -> DataFrame:
    """Unit normals of the vertices of the height-field mesh, from its faces weighted by area."""
    faces = S.height_field_faces(G.cells(points(spark, d), RES), "zmed", RES)
    return S.vertex_normals(faces).select(*CELL, *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


@query("f17_farthest_points")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """Eight cells of each survey's structures, each as far as can be from those before it."""
    p = classes(spark, d).where("cls = 'building'").select("survey_id", (F.col("i") * (1 << 31) + F.col("j")).alias("pid"), ((F.col("j") + 0.5) * RES).alias("x"), ((F.col("i") + 0.5) * RES).alias("z"))
    return S.farthest_points(p, 8)


@query("h07_reference_surface")
def h07(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed low surface after four rounds without the cells that lie far below it."""
    c = G.cells(points(spark, d), RES).select(*CELL, "zlo")
    return S.reference_surface(c, "zlo", 2.0).select(*CELL, F.round("reference", 5).alias("reference"), "used")


@query("h03_road_completion", f"""WITH RECURSIVE {cells_sql(RES)}, {CLASS_SQL}, road AS (SELECT survey_id, i, j FROM cls WHERE cls = 'ground'), gap AS (SELECT survey_id, i, j FROM cls ANTI JOIN road USING (survey_id, i, j)),
    reach4 AS (SELECT survey_id, i, j, i AS oi, j AS oj FROM gap UNION SELECT r.survey_id, r.i, r.j, o.i, o.j FROM reach4 r JOIN gap o ON o.survey_id = r.survey_id AND abs(o.i - r.oi) + abs(o.j - r.oj) = 1), lab AS (SELECT survey_id, i, j, min(oi * 2147483648 + oj) AS label FROM reach4 GROUP BY ALL),
    ends AS (SELECT survey_id, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM cls GROUP BY survey_id), open_ AS (SELECT DISTINCT lab.survey_id, label FROM lab JOIN ends USING (survey_id) WHERE i IN (i0, i1) OR j IN (j0, j1)),
    small AS (SELECT survey_id, label FROM lab ANTI JOIN open_ USING (survey_id, label) GROUP BY ALL HAVING count(*) * 6.25 <= 60) SELECT survey_id, i, j, false AS filled FROM road UNION ALL SELECT lab.survey_id, i, j, true FROM lab JOIN small USING (survey_id, label)""")
def h03(spark: SparkSession, d: str) -> DataFrame:
    """Ground with its holes of at most 60 square metres filled."""
    c = classes(spark, d)
    road = c.where("cls = 'ground'").select(*CELL)
    return S.small_holes_filled(road, c, 60.0 / (RES * RES))
