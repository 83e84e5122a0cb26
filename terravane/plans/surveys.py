"""Queries that combine rasters, objects, cameras and logs into survey products, with their SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geodesy as D
from terravane.functions.geodesy import haversine
from terravane.operators import grid as G
from terravane.operators import kernels as K
from terravane.operators import neighbour as N
from terravane.operators import telemetry as T
from terravane.plans.fixtures import POINTS_SQL, cells_sql, points
from terravane.plans.rasters import FAN, HIGH, REACH, high, observers, seen
from terravane.plans.telemetry import LOG, hav, log_of
from terravane.plans.terrain import CAMERAS, CLASS_SQL, RES, cameras, classes, raster
from terravane.session import cut_lineage, read

QUERIES, ORACLE = {}, {}
CELL = G.CELL
#: Spots of cameras that are sent to all tasks; more of them meet the points by exchange.
BROADCAST_SPOTS = 10_000


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


@query("c05_fresh_interpolation", f"""WITH {LOG}, fresh AS (SELECT * FROM (SELECT *, lag(rel) OVER q AS r0, row_number() OVER q AS k FROM log WHERE rel IS NOT NULL WINDOW q AS (PARTITION BY survey_id ORDER BY t, frame_id)) WHERE k = 1 OR abs(rel - r0) > 1e-12),
    f AS (SELECT survey_id, t, min(rel) AS rel FROM fresh GROUP BY survey_id, t), q AS (SELECT DISTINCT survey_id, CAST(floor(t / 10) AS BIGINT) AS slot, floor(t / 10) * 10 + 5 AS t FROM log),
    a AS (SELECT q.*, f.t AS ta, f.rel AS ra FROM q ASOF LEFT JOIN f ON q.survey_id = f.survey_id AND q.t >= f.t), b AS (SELECT q.survey_id, q.slot, f.t AS tb, f.rel AS rb FROM q ASOF LEFT JOIN f ON q.survey_id = f.survey_id AND q.t <= f.t)
    SELECT survey_id, slot, round(coalesce(ra + (rb - ra) * CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END, ra, rb) + 1e-8, 5) AS height_m FROM a JOIN b USING (survey_id, slot)""")
def c05(spark: SparkSession, d: str) -> DataFrame:
    """Height every ten seconds through fresh readings only."""
    log = log_of(spark, d)
    slots = log.select("survey_id", F.floor(F.col("t") / 10).alias("slot")).distinct().withColumn("t", F.col("slot") * 10.0 + 5)
    found = T.interpolate_at(slots, T.fresh_fixes(log, ["rel"]), "slot", ["rel"])
    return found.select("survey_id", "slot", F.round(F.col("rel") + 1e-8, 5).alias("height_m"))


@query("c13_clock_alignment")
def c13(spark: SparkSession, d: str) -> DataFrame:
    """Offset from the keyframes' clock to the log's at which the camera track lies best on the logged one.

    The camera track is the registered positions (x east, z south of the survey's home), which don't come
    from the log.
    """
    swapped = F.col("latlon_order") == "lon_lat"
    home = read(spark, d, "flight_data").where("home_lat IS NOT NULL AND home_lon IS NOT NULL").select("survey_id", F.when(swapped, F.col("home_lon")).otherwise(F.col("home_lat")).alias("hla"), F.when(swapped, F.col("home_lat")).otherwise(F.col("home_lon")).alias("hlo"))
    home = home.groupBy("survey_id").agg(F.min(F.struct("hla", "hlo")).alias("h")).select("survey_id", "h.*")
    frames = T.keyframes(read(spark, d, "frame_index")).where("registered AND pos_x IS NOT NULL AND pos_z IS NOT NULL")
    frames = frames.select("survey_id", "keyframe_no", F.col("timestamp_sec").alias("t"), F.col("pos_x").alias("x"), F.col("pos_z").alias("z")).distinct().join(home, "survey_id")
    east = F.col("hlo") + F.degrees(F.col("x") / (6371000.0 * F.cos(F.radians("hla"))))
    track = frames.select("survey_id", "t", (F.col("hla") - F.degrees(F.col("z") / 6371000.0)).alias("lat"), east.alias("lon"))
    log = log_of(spark, d).where(T.is_position(F.col("lat"), F.col("lon"))).select("survey_id", "t", "lat", "lon")
    found = T.align_tracks(track, log)
    return found.select("survey_id", F.round("offset_s", 4).alias("offset_s"), F.round("miss_m", 4).alias("miss_m"), "how")


@query("c21_sensor_merge")
def c21(spark: SparkSession, d: str) -> DataFrame:
    """Gimbal and altitude of a log, filled from the raw files of the same frame, the latest first."""
    from terravane.operators.schema_drift import consistent_readings

    latest = F.struct("written_at", "file_id", "line_no")
    raw = consistent_readings(read(spark, d, "raw_logs")).groupBy("survey_id", "frame_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), latest)).alias(f"raw_{c}") for c in ("gb_pitch", "gb_yaw", "absolute_altitude_m")])
    log = log_of(spark, d).join(raw, ["survey_id", "frame_id"], "left")
    return log.select("survey_id", "frame_id", F.coalesce("gb_pitch", "raw_gb_pitch").alias("gb_pitch"), F.coalesce("gb_yaw", "raw_gb_yaw").alias("gb_yaw"), F.coalesce("abs_m", "raw_absolute_altitude_m").alias("abs_m"))


@query("d14_ground_plane")
def d14(spark: SparkSession, d: str) -> DataFrame:
    """Consensus plane of each survey through one low point for each 10 m block."""
    low = points(spark, d).groupBy("survey_id", F.floor(F.col("x") / 10).alias("bx"), F.floor(F.col("z") / 10).alias("bz")).agg(F.min(F.struct("y", "x", "z")).alias("p")).select("survey_id", "p.*")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "z"])
        found = K.consensus_plane(*(pdf[c].to_numpy() for c in "xzy"), tolerance=0.1)
        if found is None:
            return pd.DataFrame(columns=["survey_id", "a", "b", "c", "share"])
        fit, near = found
        return pd.DataFrame({"survey_id": [pdf["survey_id"].iloc[0]], "a": [fit[0]], "b": [fit[1]], "c": [fit[2]], "share": [float(near.mean())]})

    return low.groupBy("survey_id").applyInPandas(work, "survey_id string, a double, b double, c double, share double")


@query("d12_consensus_similarity")
def d12(spark: SparkSession, d: str) -> DataFrame:
    """Similarity by seeded samples: hypotheses of three pairs are scored against all pairs at once.

    The sampled pairs (three for each of 60 hypotheses) are all that reaches the driver; the count of
    agreeing pairs is one aggregation with a column for each hypothesis.
    """
    from terravane.plans.geodesy import fit_pairs

    pairs = fit_pairs(spark, d).withColumn("tx", F.col("tx") + F.when(F.col("keyframe_no") % 5 == 0, 90.0).otherwise(0.0))
    ordered = pairs.select("x", "z", "tx", "tz").orderBy(F.xxhash64("survey_id", "keyframe_no", F.lit(7))).limit(180).collect()
    p = np.array([tuple(r) for r in ordered], dtype=float)
    if len(p) < 3:
        return spark.createDataFrame([], "scale double, turn_deg double, agree bigint")
    fits = [K.similarity(q[:, :2], q[:, 2:]) for q in (p[k : k + 3] for k in range(0, len(p) - 2, 3))]
    agree = []
    for n, (s, r, t) in enumerate(fits):
        u = s * (r[0][0] * F.col("x") + r[0][1] * F.col("z")) + float(t[0]) - F.col("tx")
        v = s * (r[1][0] * F.col("x") + r[1][1] * F.col("z")) + float(t[1]) - F.col("tz")
        agree.append(F.count_if(u * u + v * v <= 36.0).alias(f"h{n}"))
    counts = list(pairs.agg(*agree).first())
    best = int(np.argmax(counts))
    s, r, _ = fits[best]
    return spark.createDataFrame([(round(s, 6), round(math.degrees(math.atan2(r[1][0], r[0][0])), 5), int(counts[best]))], "scale double, turn_deg double, agree bigint")


@query("d16_camera_heights", f"""WITH {POINTS_SQL}, {CAMERAS}, n AS (SELECT k.survey_id, k.pid, k.y - quantile_cont(p.y, 0.15) AS h, count(*) AS n FROM cams k JOIN pts p ON p.survey_id = k.survey_id AND abs(p.x - k.x) <= 4 AND abs(p.z - k.z) <= 4 AND sqrt(pow(p.x - k.x, 2) + pow(p.z - k.z, 2)) <= 4 GROUP BY k.survey_id, k.pid, k.y)
    SELECT survey_id, pid, n, round(h, 5) AS height_m FROM n WHERE n >= 30""")
def d16(spark: SparkSession, d: str) -> DataFrame:
    """Height of cameras over the low points within four metres.

    Cameras at one spot are over the same points, so points meet each spot once, however many cameras
    are there, and no pair is exchanged; a camera listed several times counts its points as often.
    """
    p = points(spark, d).select("survey_id", F.lit(-1).alias("pid"), "x", "z", "y")
    cams = cameras(spark, d).groupBy("survey_id", "pid", "x", "z", "y").agg(F.count("*").alias("times"))
    spots = cams.select("survey_id", "x", "z", "times").where("x IS NOT NULL AND z IS NOT NULL").distinct()
    spots = F.broadcast(spots) if spots.count() <= BROADCAST_SPOTS else spots
    spot = ["survey_id", "o_x", "o_z", "o_times"]
    near = G.within(p, spots, 4.0, keep_self=True).select(*spot, "y")
    n = near.groupBy(*spot).agg((F.count("*") * F.col("o_times")).alias("n")).where("n >= 30")
    h = n.join(G.quantile(near, spot, "y", 0.15, "low", times="o_times"), spot, "left")
    h = h.select("survey_id", F.col("o_x").alias("x"), F.col("o_z").alias("z"), F.col("o_times").alias("times"), "n", "low")
    return cams.join(h, ["survey_id", "x", "z", "times"]).select("survey_id", "pid", "n", F.round(F.col("y") - F.col("low"), 5).alias("height_m"))


SEEN_SQL = f"WITH {cells_sql(RES)}, mask AS (SELECT survey_id, i, j FROM cells WHERE n >= 14)"


@query("e06_observed_region", f"""{SEEN_SQL}, dl AS (SELECT DISTINCT survey_id, i + a AS i, j + b AS j FROM mask, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b)),
    er AS (SELECT m.survey_id, m.i, m.j FROM dl m JOIN dl o ON o.survey_id = m.survey_id AND abs(o.i - m.i) <= 1 AND abs(o.j - m.j) <= 1 GROUP BY ALL HAVING count(*) = 9) SELECT survey_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM er UNION SELECT survey_id, i, j FROM mask""")
def e06(spark: SparkSession, d: str) -> DataFrame:
    """Cells with points, and the small gaps between them closed."""
    return N.close_mask(G.cells(points(spark, d), RES).where("n >= 14").select(*CELL), 1)


@query("e07_track_reach", f"""WITH {cells_sql(RES)}, {CAMERAS}, lo AS (SELECT survey_id, avg(zlo) AS g FROM cells GROUP BY survey_id), t AS (SELECT cams.survey_id, CAST(floor(z / 2.5) AS BIGINT) AS i, CAST(floor(x / 2.5) AS BIGINT) AS j, max(greatest(40.0, (y - g) / tan(radians(8.0)))) AS reach FROM cams JOIN lo USING (survey_id) GROUP BY ALL),
    m AS (SELECT c.survey_id, c.i, c.j, min(row(CAST(pow(c.i - t.i, 2) + pow(c.j - t.j, 2) AS BIGINT), t.i, t.j, reach)) AS k FROM cells c JOIN t ON t.survey_id = c.survey_id GROUP BY ALL) SELECT survey_id, i, j FROM m WHERE sqrt(k[1]) * 2.5 <= k[4]""")
def e07(spark: SparkSession, d: str) -> DataFrame:
    """Cells within reach of the nearest camera: 40 m, or as far as it looks down at 8 degrees at least."""
    c = G.cells(points(spark, d), RES).select(*CELL, "zlo")
    ground = c.groupBy("survey_id").agg(F.avg("zlo").alias("g"))
    reach = F.greatest(F.lit(40.0), (F.col("y") - F.col("g")) / F.tan(F.radians(F.lit(8.0))))
    track = G.with_cell(cameras(spark, d), RES).join(ground, "survey_id").groupBy(*CELL).agg(F.max(reach).alias("reach"))
    near = N.distance_to(c.select(*CELL), track.select(*CELL)).where("distance IS NOT NULL")
    held = near.join(track.select("survey_id", F.col("i").alias("near_i"), F.col("j").alias("near_j"), "reach"), ["survey_id", "near_i", "near_j"])
    return held.where(F.col("distance") * RES <= F.col("reach")).select(*CELL)


@query("e08_density_gate", f"""WITH {cells_sql(RES)}, w AS (SELECT c.survey_id, c.i, c.j, count(CASE WHEN o.n >= 16 THEN 1 END) / 9.0 AS share FROM cells c JOIN cells o ON o.survey_id = c.survey_id AND abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1 GROUP BY ALL) SELECT survey_id, i, j, round(share, 6) AS share FROM w WHERE share >= 0.45""")
def e08(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose surroundings are dense enough."""
    g = raster(spark, d).withColumn("full", (F.col("n") >= 16).cast("int"))
    share = F.coalesce("s", F.lit(0)) / 9.0
    return G.box(g, 1, s=("full", "sum")).where("n IS NOT NULL").select(*CELL, F.round(share, 6).alias("share")).where(share >= 0.45)


@query("e09_speckle_fill", f"""{SEEN_SQL}, k AS (SELECT c.survey_id, c.i, c.j, c.zmed, m.i IS NOT NULL AS ok FROM cells c LEFT JOIN mask m ON m.survey_id = c.survey_id AND m.i = c.i AND m.j = c.j),
    f AS (SELECT c.survey_id, c.i, c.j, min(row(CAST(pow(o.i - c.i, 2) + pow(o.j - c.j, 2) AS BIGINT), o.i, o.j, o.zmed)) AS m FROM k c JOIN k o ON o.ok AND o.survey_id = c.survey_id AND pow(o.i - c.i, 2) + pow(o.j - c.j, 2) <= 16 WHERE NOT c.ok GROUP BY ALL) SELECT survey_id, i, j, round(m[4], 6) AS filled FROM f""")
def e09(spark: SparkSession, d: str) -> DataFrame:
    """Sparse cells take the layer of the nearest dense one."""
    g = G.cells(points(spark, d), RES).select(*CELL, F.when(F.col("n") >= 14, F.col("zmed")).alias("v"))
    return N.nearest_fill(g, "v", "filled", 4).where("v IS NULL AND filled IS NOT NULL").select(*CELL, F.round("filled", 6).alias("filled"))


@query("e17_land_cover")
def e17(spark: SparkSession, d: str) -> DataFrame:
    """Classes by component: tall cells are joined and judged by area, colour, roughness and shape."""
    g = G.colour_indices(G.plane_rms(raster(spark, d), "zhi", 2)).withColumn("h", F.col("zhi") - F.col("zlo"))
    tall = N.components(g.where("h >= 9").select(*CELL)).join(g.select(*CELL, "h", "exg", "rough"), CELL)
    m = tall.groupBy("survey_id", "label").agg((F.count("*") * RES * RES).alias("area"), F.percentile("exg", F.lit(0.5)).alias("green"), F.percentile("rough", F.lit(0.5)).alias("rough"), F.max("h").alias("top"), F.var_pop("i").alias("a"), F.var_pop("j").alias("b"), F.covar_pop("i", "j").alias("c"))
    half = (F.col("a") + F.col("b")) / 2
    q = F.sqrt(F.greatest(F.lit(0.0), half * half - F.col("a") * F.col("b") + F.col("c") * F.col("c")))
    side = lambda v: F.sqrt(12 * F.greatest(F.lit(0.0), v)) * RES + RES
    length, width = side(half + q), side(half - q)
    vehicle = F.col("area").between(2, 45) & (F.col("top") <= 4.2) & (F.col("green") < 0.03) & (F.col("rough") < 0.25) & (width <= 4) & (length >= 1.35 * width)
    building = (F.col("green") < 0.03) & (F.col("rough") < 0.18) & (F.col("area") >= 12)
    cls = F.when(vehicle, "vehicle").when(building, "building").when((F.col("green") >= 0.03) | (F.col("rough") >= 0.18), "tree").when(F.col("area") >= 4, "building").otherwise("tree")
    named = tall.select(*CELL, "label").join(m.select("survey_id", "label", cls.alias("cls")), ["survey_id", "label"])
    low = g.where("h < 9 AND n IS NOT NULL").select(*CELL, F.when((F.col("h") >= 0.35) & (F.col("exg") > 0.04), "low_vegetation").otherwise("ground").alias("cls"))
    return low.unionByName(named.select(*CELL, "cls"))


@query("e26_utm_raster")
def e26(spark: SparkSession, d: str) -> DataFrame:
    """Surface on a UTM grid: grid points go back to the model frame and are sampled there."""
    origin = (45.3, 29.3, 0.0)
    g = G.cells(points(spark, d), 5.0)
    zone = 35
    east0, north0 = (math.floor(v / 10) * 10.0 for v in D.utm_point(*origin[:2], zone))
    frame = g.select("survey_id").distinct().withColumn("e", F.explode(F.sequence(F.lit(-20), F.lit(120), F.lit(10)))).withColumn("n", F.explode(F.sequence(F.lit(-120), F.lit(20), F.lit(10))))
    lat, lon = D.utm_inverse(F.col("e") + east0, F.col("n") + north0, F.lit(zone), F.lit(True))
    frame = frame.select("survey_id", "e", "n", lat.alias("lat"), lon.alias("lon"))
    x, y, _ = D.to_enu(F.col("lat"), F.col("lon"), F.lit(0.0), origin)
    at = frame.withColumn("x", x).withColumn("z", -y).where("x BETWEEN 0 AND 100 AND z BETWEEN 0 AND 100")
    return G.sample_bilinear(at, g, "zhi", 5.0, "h").select("survey_id", (F.col("e") + east0).alias("easting"), (F.col("n") + north0).alias("northing"), F.round("h", 4).alias("height_m"))


def linked_sql(d: float, least: int = 3) -> str:
    """CTEs over alerts (survey_id, pid, x, z): links of at most d, and clusters of at least some members."""
    return f"""link AS (SELECT a.survey_id, a.pid AS a, b.pid AS b FROM alerts a JOIN alerts b ON a.survey_id = b.survey_id WHERE pow(a.x - b.x, 2) + pow(a.z - b.z, 2) <= {d * d}), way AS (SELECT survey_id, a, b FROM link UNION SELECT w.survey_id, w.a, l.b FROM way w JOIN link l ON l.survey_id = w.survey_id AND l.a = w.b),
    root AS (SELECT survey_id, a AS pid, min(b) AS label FROM way GROUP BY ALL) SELECT survey_id, CAST(label AS BIGINT) AS label, count(*) AS members FROM root GROUP BY ALL HAVING count(*) >= {least}"""


ALERTS = f"WITH RECURSIVE {cells_sql(RES)}, {CLASS_SQL}, mask AS (SELECT survey_id, i, j FROM cls WHERE h > 9.35), {REACH}, alerts AS (SELECT survey_id, CAST(label AS BIGINT) AS pid, (avg(j) + 0.5) * 2.5 AS x, (avg(i) + 0.5) * 2.5 AS z FROM lab GROUP BY survey_id, label)"


@query("f16_alert_clusters", f"{ALERTS}, {linked_sql(6.0)}")
def f16(spark: SparkSession, d: str) -> DataFrame:
    """Objects whose centres are linked within 6 m, in clusters of at least three."""
    o = N.components(high(spark, d)).groupBy("survey_id", F.col("label").alias("pid")).agg(((F.avg("j") + 0.5) * RES).alias("x"), ((F.avg("i") + 0.5) * RES).alias("z"))
    return G.linked(cut_lineage(o), 6.0).groupBy("survey_id", "label").agg(F.count("*").alias("members")).where("members >= 3")


@query("g06_cell_median_top", f"""WITH {POINTS_SQL}, m AS (SELECT survey_id, CAST(floor(z / 10) AS BIGINT) AS bi, CAST(floor(x / 10) AS BIGINT) AS bj, CAST(floor(z / 2) AS BIGINT) AS i, CAST(floor(x / 2) AS BIGINT) AS j, quantile_cont(y, 0.5) AS m FROM pts GROUP BY ALL) SELECT survey_id, bi, bj, round(quantile_cont(m, 0.95), 5) AS top_m FROM m GROUP BY survey_id, bi, bj""")
def g06(spark: SparkSession, d: str) -> DataFrame:
    """Top of an object as the 95th percentile of the medians of its small cells."""
    f = lambda c, s, n: F.floor(F.col(c) / s).alias(n)
    m = points(spark, d).groupBy("survey_id", f("z", 10, "bi"), f("x", 10, "bj"), f("z", 2, "i"), f("x", 2, "j")).agg(F.percentile("y", F.lit(0.5)).alias("m"))
    return m.groupBy("survey_id", "bi", "bj").agg(F.round(F.percentile("m", F.lit(0.95)), 5).alias("top_m"))


@query("g08_height_with_error", f"""{HIGH}, {REACH}, o AS (SELECT lab.survey_id, label, count(*) AS n, max(zhi) AS top, quantile_cont(zlo, 0.5) AS base, stddev_pop(zhi) AS st, stddev_pop(zlo) AS sb FROM lab JOIN cls USING (survey_id, i, j) GROUP BY lab.survey_id, label HAVING count(*) >= 2)
    SELECT survey_id, CAST(label AS BIGINT) AS label, round(top - base, 5) AS height_m, round(1.96 * sqrt(st * st / n + sb * sb / n + pow(0.003 * (top - base), 2) + pow(2.5 / 6, 2)), 5) AS error_m FROM o""")
def g08(spark: SparkSession, d: str) -> DataFrame:
    """Object heights and their 95 % error from the scatter of top and base, scale and spacing."""
    c = classes(spark, d).select(*CELL, "zhi", "zlo")
    o = N.components(high(spark, d)).join(c, CELL).groupBy("survey_id", "label").agg(F.count("*").alias("n"), F.max("zhi").alias("top"), F.percentile("zlo", F.lit(0.5)).alias("base"), F.stddev_pop("zhi").alias("st"), F.stddev_pop("zlo").alias("sb")).where("n >= 2")
    h = F.col("top") - F.col("base")
    var = F.col("st") * F.col("st") / F.col("n") + F.col("sb") * F.col("sb") / F.col("n") + F.pow(0.003 * h, 2) + (2.5 / 6) ** 2
    return o.select("survey_id", "label", F.round(h, 5).alias("height_m"), F.round(1.96 * F.sqrt(var), 5).alias("error_m"))


CALIPER = "m AS (SELECT c.survey_id, c.k, quantile_cont(p.x, 0.5) AS x, quantile_cont(p.y, 0.5) AS y, quantile_cont(p.z, 0.5) AS z FROM clicks c JOIN pts p ON p.survey_id = c.survey_id AND sqrt(pow(p.x - c.x, 2) + pow(p.z - c.z, 2)) <= 1.5 GROUP BY c.survey_id, c.k)"


@query("g12_caliper", f"""WITH {POINTS_SQL}, clicks AS (SELECT s.survey_id, k, 20.0 + 5 * k AS x, 80.0 - 5 * k AS z FROM (SELECT unnest(['day1', 'day2']) AS survey_id) s, (SELECT unnest(range(0, 12)) AS k)), {CALIPER}
    SELECT a.survey_id, a.k, round(sqrt(pow(b.x - a.x, 2) + pow(b.z - a.z, 2)), 5) AS horizontal_m, round(b.y - a.y, 5) AS vertical_m, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)), 5) AS distance_m FROM m a JOIN m b ON b.survey_id = a.survey_id AND b.k = a.k + 1""")
def g12(spark: SparkSession, d: str) -> DataFrame:
    """Distances between clicked places, each snapped to the median of the points around it."""
    clicks = points(spark, d).select("survey_id").distinct().withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>"))).withColumn("x", 20.0 + 5 * F.col("pid")).withColumn("z", 80.0 - 5 * F.col("pid"))
    near = G.within(points(spark, d).select("survey_id", F.lit(-1).alias("pid"), "x", "y", "z"), clicks, 1.5, keep_self=True)
    m = near.groupBy("survey_id", F.col("o_pid").alias("k")).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in "xyz"])
    b = m.select("survey_id", (F.col("k") - 1).alias("k"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    dx, dy, dz = (F.col(f"{c}1") - F.col(c) for c in "xyz")
    return m.join(b, ["survey_id", "k"]).select("survey_id", "k", F.round(F.sqrt(dx * dx + dz * dz), 5).alias("horizontal_m"), F.round(dy, 5).alias("vertical_m"), F.round(F.sqrt(dx * dx + dy * dy + dz * dz), 5).alias("distance_m"))


@query("g03_spikes_removed", f"""WITH {POINTS_SQL}, p AS (SELECT survey_id, x, z, CAST(floor(x / 0.5) AS BIGINT) AS bx, CAST(floor(z / 0.5) AS BIGINT) AS bz, row_number() OVER () AS id FROM pts), q AS (SELECT survey_id, x, z, bx + a AS bx, bz + b AS bz FROM p, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b)),
    k AS (SELECT p.survey_id, p.id, count(*) AS n FROM p JOIN q o ON o.survey_id = p.survey_id AND o.bx = p.bx AND o.bz = p.bz WHERE sqrt(pow(p.x - o.x, 2) + pow(p.z - o.z, 2)) <= 0.5 GROUP BY p.survey_id, p.id) SELECT survey_id, count(*) AS n FROM k WHERE n >= 4 GROUP BY survey_id""")
def g03(spark: SparkSession, d: str) -> DataFrame:
    """Points with at least four points, themselves included, within half a metre."""
    return G.crowded(points(spark, d), 0.5, 4).groupBy("survey_id").agg(F.count("*").alias("n"))


@query("h05_road_mask", f"WITH {cells_sql(RES)}, {CLASS_SQL} SELECT survey_id, CASE WHEN i BETWEEN 10 AND 14 AND cls NOT IN ('building') THEN 'road' ELSE cls END AS cls, count(*) AS n FROM cls GROUP BY ALL")
def h05(spark: SparkSession, d: str) -> DataFrame:
    """Classes with a road mask written over all but buildings."""
    road = F.when(F.col("i").between(10, 14) & (F.col("cls") != "building"), "road").otherwise(F.col("cls"))
    return classes(spark, d).groupBy("survey_id", road.alias("cls")).agg(F.count("*").alias("n"))


@query("h06_fine_surface", f"""WITH {POINTS_SQL}, r AS (SELECT survey_id, CAST(floor(z / 1.2) AS BIGINT) AS i, CAST(floor(x / 1.2) AS BIGINT) AS j, y, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY survey_id, floor(z / 1.2), floor(x / 1.2)) AS n FROM pts WINDOW w AS (PARTITION BY survey_id, floor(z / 1.2), floor(x / 1.2) ORDER BY y))
    SELECT survey_id, i, j, round(max(CASE WHEN rk = (n - 1) // 2 THEN y END), 6) AS surface FROM r GROUP BY ALL""")
def h06(spark: SparkSession, d: str) -> DataFrame:
    """Lower median height of fine cells."""
    r = G.ranked(G.with_cell(points(spark, d), 1.2), CELL, "y")
    lower = F.max(F.when(F.col("rk") == F.floor((F.col("n") - 1) / 2), F.col("y")))
    return r.groupBy(*CELL).agg(F.round(lower, 6).alias("surface"))


@query("h12_road_report", """WITH h AS (SELECT p_brand AS road, p_type AS surface, p_size AS depth_mm, p_retailprice % 900 AS across FROM part) SELECT road, count(*) AS holes, CAST(count(*) FILTER (WHERE depth_mm > 50) AS BIGINT) AS deep, max(depth_mm) AS deepest_mm, round(sum(across * across) / 1e6, 4) AS area_m2,
    CASE WHEN count(*) FILTER (WHERE depth_mm > 48) >= 5 THEN 'CRITICAL' WHEN count(*) FILTER (WHERE depth_mm > 48) >= 1 THEN 'CAUTION' ELSE 'PASSABLE' END AS status FROM h GROUP BY road""")
def h12(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "part").select(F.col("p_brand").alias("road"), F.col("p_size").alias("depth"), (F.col("p_retailprice") % 900).alias("across"))
    bad = F.count_if(F.col("depth") > 48)
    status = F.when(bad >= 5, "CRITICAL").when(bad >= 1, "CAUTION").otherwise("PASSABLE")
    return h.groupBy("road").agg(F.count("*").alias("holes"), F.count_if(F.col("depth") > 50).alias("deep"), F.max("depth").alias("deepest_mm"), F.round(F.sum(F.col("across") * F.col("across")) / 1e6, 4).alias("area_m2"), status.alias("status"))


@query("i01_default_observers", f"""{HIGH}, {REACH}, o AS (SELECT lab.survey_id, label, count(*) AS n, avg(lab.i) AS ci, avg(lab.j) AS cj, max(zhi) AS top FROM lab JOIN cls USING (survey_id, i, j) GROUP BY lab.survey_id, label HAVING count(*) * 6.25 >= 15)
    SELECT survey_id, round((cj + 0.5) * 2.5, 5) AS x, round((ci + 0.5) * 2.5, 5) AS z, round(top + 0.3, 5) AS eye FROM o""")
def i01(spark: SparkSession, d: str) -> DataFrame:
    """One observer above each structure of at least 15 square metres."""
    return observers(spark, d).select("survey_id", *[F.round(c, 5).alias(c) for c in ("x", "z", "eye")])


SITE = f"""WITH RECURSIVE {cells_sql(RES)}, {CLASS_SQL}, {FAN}, ex AS (SELECT survey_id, i, j, 1 - exp(sum(ln(1 - 0.95 * pow(2.0, -pow(distance / 350.0, 2))))) AS e FROM vis GROUP BY ALL),
    nb AS (SELECT c.survey_id, c.i, c.j, min(sqrt(pow(o.i - c.i, 2) + pow(o.j - c.j, 2))) * 2.5 AS d FROM cls c JOIN cls o ON o.survey_id = c.survey_id AND o.cls = 'building' WHERE c.cls <> 'building' GROUP BY ALL),
    s AS (SELECT c.survey_id, c.i, c.j, 100 * (0.52 * least(1, coalesce(d, 15) / 15) + 0.48 * (1 - least(1, coalesce(e, 0) / 0.6))) AS score FROM cls c LEFT JOIN nb USING (survey_id, i, j) LEFT JOIN ex USING (survey_id, i, j) WHERE c.cls <> 'building')"""


@query("i04_site_suitability", f"{SITE} SELECT survey_id, i, j, round(score, 4) AS score FROM s")
def i04(spark: SparkSession, d: str) -> DataFrame:
    """Score of open cells: distance from structures and concealment."""
    c = classes(spark, d)
    open_ = c.where("cls <> 'building'").select(*CELL)
    near = N.distance_to(open_, c.where("cls = 'building'").select(*CELL))
    e = N.exposure(seen(spark, d)).select(*CELL, "exposure")
    away = F.least(F.lit(1.0), F.coalesce(F.col("distance") * RES, F.lit(15.0)) / 15)
    hidden = 1 - F.least(F.lit(1.0), F.coalesce("exposure", F.lit(0.0)) / 0.6)
    return near.join(e, CELL, "left").select(*CELL, F.round(100 * (0.52 * away + 0.48 * hidden), 4).alias("score"))


def greedy_sites(scores: DataFrame, most: int = 5, apart_m: float = 25.0) -> DataFrame:
    """The best cell of each survey, then the best at least ``apart_m`` from those chosen, and so on.

    Each choice is an aggregation over all cells; the chosen ones are at most ``most`` rows a survey.
    """
    scores = cut_lineage(scores.select(*CELL, "score"))
    chosen = None
    for n in range(most):
        left = scores
        if chosen is not None:
            c = chosen.select(*[F.col(x).alias(f"c_{x}") for x in CELL])
            di, dj = F.col("i") - F.col("c_i"), F.col("j") - F.col("c_j")
            left = scores.join(F.broadcast(c), (F.col("survey_id") == F.col("c_survey_id")) & (F.sqrt((di * di + dj * dj).cast("double")) * RES < apart_m), "left_anti")
        best = left.groupBy("survey_id").agg(F.max(F.struct("score", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("m"))
        best = best.select("survey_id", F.lit(f"SITE-{chr(65 + n)}").alias("site"), (-F.col("m.i")).alias("i"), (-F.col("m.j")).alias("j"), F.col("m.score").alias("score"))
        chosen = cut_lineage(best if chosen is None else chosen.unionByName(best))
    return chosen


@query("i06_best_sites")
def i06(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice of the five best sites, at least 25 m apart, over all cells."""
    return greedy_sites(i04(spark, d))


@query("j01_location_check", f"""WITH {LOG}, c AS (SELECT survey_id, CAST(floor(lat * 1000) AS BIGINT) AS a, CAST(floor(lon * 1000) AS BIGINT) AS o FROM log WHERE abs(lat) <= 90 AND abs(lon) <= 180 GROUP BY ALL), s AS (SELECT DISTINCT survey_id, site FROM flight_data), p AS (SELECT site, survey_id, lag(survey_id) OVER (PARTITION BY site ORDER BY survey_id) AS other FROM s)
    SELECT p.survey_id, p.other, CAST(count(y.a) AS BIGINT) AS shared FROM p JOIN c x ON x.survey_id = p.survey_id LEFT JOIN c y ON y.survey_id = p.other AND y.a = x.a AND y.o = x.o WHERE p.other IS NOT NULL GROUP BY ALL""")
def j01(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 0.001 degrees that a survey shares with the one before it at its site."""
    c = log_of(spark, d).where("abs(lat) <= 90 AND abs(lon) <= 180").select("survey_id", F.floor(F.col("lat") * 1000).alias("a"), F.floor(F.col("lon") * 1000).alias("o")).distinct()
    sites = read(spark, d, "flight_data").select("survey_id", "site").distinct()
    pairs = sites.withColumn("other", F.lag("survey_id").over(Window.partitionBy("site").orderBy("survey_id"))).where("other IS NOT NULL").select("survey_id", "other")
    theirs = c.select(F.col("survey_id").alias("other"), "a", "o", F.lit(1).alias("hit"))
    return c.join(pairs, "survey_id").join(theirs, ["other", "a", "o"], "left").groupBy("survey_id", "other").agg(F.count("hit").alias("shared"))


@query("l02_oriented_normals", f"""WITH {cells_sql(RES)}, {CAMERAS}, n AS (SELECT c.survey_id, c.i, c.j, c.zmed, lead(zmed) OVER w - zmed AS gx FROM cells c WINDOW w AS (PARTITION BY c.survey_id, c.i ORDER BY c.j)), m AS (SELECT n.survey_id, n.i, n.j, gx, zmed, min(row(sqrt(pow((n.j + 0.5) * 2.5 - k.x, 2) + pow((n.i + 0.5) * 2.5 - k.z, 2)), k.pid, k.x, k.y)) AS k FROM n JOIN cams k ON k.survey_id = n.survey_id WHERE gx IS NOT NULL AND sqrt(pow((n.j + 0.5) * 2.5 - k.x, 2) + pow((n.i + 0.5) * 2.5 - k.z, 2)) <= 20 GROUP BY ALL)
    SELECT survey_id, i, j, CASE WHEN -gx / 2.5 * (k[3] - (j + 0.5) * 2.5) + (k[4] - zmed) >= 0 THEN 1 ELSE -1 END AS sign FROM m""")
def l02(spark: SparkSession, d: str) -> DataFrame:
    """Whether a surface normal already points to the nearest camera."""
    w = Window.partitionBy("survey_id", "i").orderBy("j")
    c = G.cells(points(spark, d), RES).select("survey_id", "i", "j", ((F.col("j") + 0.5) * RES).alias("x"), ((F.col("i") + 0.5) * RES).alias("z"), "zmed", (F.lead("zmed").over(w) - F.col("zmed")).alias("gx")).where("gx IS NOT NULL")
    near = G.nearest(c, cameras(spark, d), 20.0, keep_self=True, key=["i", "j"])
    dot = -F.col("gx") / RES * (F.col("o_x") - F.col("x")) + (F.col("o_y") - F.col("zmed"))
    return near.select(*CELL, F.when(dot >= 0, 1).otherwise(-1).alias("sign"))


@query("l04_height_field_mesh", f"""WITH {cells_sql(RES)}, q AS (SELECT a.survey_id, a.i, a.j FROM cells a JOIN cells b ON b.survey_id = a.survey_id AND b.i = a.i AND b.j = a.j + 1 JOIN cells c ON c.survey_id = a.survey_id AND c.i = a.i + 1 AND c.j = a.j JOIN cells e ON e.survey_id = a.survey_id AND e.i = a.i + 1 AND e.j = a.j + 1) SELECT survey_id, count(*) * 2 AS faces FROM q GROUP BY survey_id""")
def l04(spark: SparkSession, d: str) -> DataFrame:
    """Two triangles for each square of cells that all have a height."""
    c = G.cells(points(spark, d), RES).select(*CELL)
    right, down = Window.partitionBy("survey_id", "i").orderBy("j"), Window.partitionBy("survey_id", "j").orderBy("i")
    flags = c.withColumn("r", F.lead("j").over(right) == F.col("j") + 1).withColumn("dn", F.lead("i").over(down) == F.col("i") + 1)
    flags = flags.withColumn("dr", F.lead("r").over(down))
    return flags.where("r AND dn AND dr").groupBy("survey_id").agg((F.count("*") * 2).alias("faces"))


@query("l10_spatial_pairs", """WITH p AS (SELECT DISTINCT survey_id, keyframe_no AS k, pos_x AS x, pos_z AS z FROM frame_index WHERE registered AND pos_x IS NOT NULL), n AS (SELECT a.survey_id, a.k, b.k AS o, sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)) AS m FROM p a JOIN p b ON a.survey_id = b.survey_id AND a.k <> b.k AND abs(a.x - b.x) <= 12 AND abs(a.z - b.z) <= 12),
    r AS (SELECT *, row_number() OVER (PARTITION BY survey_id, k ORDER BY m, o) AS q FROM n WHERE m <= 12) SELECT survey_id, k AS keyframe_no, o AS other FROM r WHERE q <= 4 AND abs(k - o) > 2""")
def l10(spark: SparkSession, d: str) -> DataFrame:
    """The four nearest frames of each frame, without its neighbours in sequence."""
    p = read(spark, d, "frame_index").where("registered AND pos_x IS NOT NULL").select("survey_id", F.col("keyframe_no").alias("pid"), F.col("pos_x").alias("x"), F.col("pos_z").alias("z")).distinct()
    near = G.nearest(p, p, 12.0, k=4)
    return near.where(F.abs(F.col("pid") - F.col("o_pid")) > 2).select("survey_id", F.col("pid").alias("keyframe_no"), F.col("o_pid").alias("other"))


@query("c22_track_distance", f"""WITH {LOG}, f AS (SELECT survey_id, lat, lon, lag(lat) OVER q AS a, lag(lon) OVER q AS o FROM log WHERE lat IS NOT NULL AND lon IS NOT NULL WINDOW q AS (PARTITION BY survey_id ORDER BY t, frame_id)) SELECT survey_id, round(max(CASE WHEN {hav('a', 'o', 'lat', 'lon')} < 1000 THEN {hav('a', 'o', 'lat', 'lon')} END), 3) AS longest_leg_m FROM f GROUP BY survey_id""")
def c22b(spark: SparkSession, d: str) -> DataFrame:
    from terravane.operators.sequences import with_context

    fixes = log_of(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL")
    seen_ = with_context(fixes, ["survey_id"], ["t", "frame_id"], 3600.0, previous={"a": "lat", "o": "lon"})
    leg = haversine(F.col("a"), F.col("o"), F.col("lat"), F.col("lon"))
    return seen_.groupBy("survey_id").agg(F.round(F.max(F.when(leg < 1000, leg)), 3).alias("longest_leg_m"))
