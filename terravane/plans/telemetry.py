"""Queries over flight logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions.geodesy import bearing, haversine
from terravane.operators import grid as G
from terravane.operators import telemetry as T
from terravane.session import read

LOG = """log AS (SELECT DISTINCT survey_id, frame_id, time_s AS t, latitude AS lat, longitude AS lon, relative_altitude_m AS rel,
    absolute_altitude_m AS abs_m, gb_pitch, gb_yaw, rtk_q FROM waypoints WHERE time_s IS NOT NULL)"""
HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
COURSE = """(degrees(atan2(sin(radians({d} - {c})) * cos(radians({b})), cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos(radians({d} - {c})))) + 360.0) % 360.0"""


def hav(a: str, c: str, b: str, d: str) -> str:
    """SQL of the distance from (a, c) to (b, d), latitude first."""
    return HAV.format(a=a, b=b, c=c, d=d)


def course(a: str, c: str, b: str, d: str) -> str:
    return COURSE.format(a=a, b=b, c=c, d=d)


QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.flight_log(read(spark, sf_dir, "waypoints"))


@query("c01_valid_positions", f"""WITH {LOG} SELECT survey_id, count(*) AS n,
    CAST(count(*) FILTER (WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (abs(lat) < 1e-9 AND abs(lon) < 1e-9)) AS BIGINT) AS n_valid FROM log GROUP BY survey_id""")
def c01(spark: SparkSession, d: str) -> DataFrame:
    ok = T.is_position(F.col("lat"), F.col("lon"))
    return log_of(spark, d).groupBy("survey_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


@query("c02_gap_interpolation", f"""WITH {LOG}, k AS (SELECT *, row_number() OVER q AS k FROM log WINDOW q AS (PARTITION BY survey_id ORDER BY t, frame_id)),
    s AS (SELECT *, last_value(CASE WHEN rel IS NOT NULL THEN k END IGNORE NULLS) OVER a AS ka, last_value(rel IGNORE NULLS) OVER a AS va,
          first_value(CASE WHEN rel IS NOT NULL THEN k END IGNORE NULLS) OVER b AS kb, first_value(rel IGNORE NULLS) OVER b AS vb FROM k
          WINDOW a AS (PARTITION BY survey_id ORDER BY t, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 b AS (PARTITION BY survey_id ORDER BY t, frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT survey_id, frame_id, round(CASE WHEN rel IS NOT NULL THEN rel WHEN ka IS NULL THEN vb WHEN kb IS NULL THEN va ELSE va + (vb - va) * (k - ka) / (kb - ka) END + 1e-8, 5) AS height_m FROM s""")
def c02(spark: SparkSession, d: str) -> DataFrame:
    return T.fill_by_index(log_of(spark, d), "rel", "h").select("survey_id", "frame_id", F.round(F.col("h") + 1e-8, 5).alias("height_m"))


@query("c03_altitude_reference", f"""WITH {LOG}, r AS (SELECT survey_id, count(*) AS n, count(abs_m) AS n_abs, count(CASE WHEN abs_m IS NULL THEN rel END) AS n_rel FROM log GROUP BY survey_id)
    SELECT survey_id, CASE WHEN n_abs + n_rel < 0.5 * n THEN 'estimated' WHEN n_abs >= n_rel THEN 'absolute' ELSE 'relative' END AS reference, CAST(n_abs AS BIGINT) AS n_abs, CAST(n_rel AS BIGINT) AS n_rel FROM r""")
def c03(spark: SparkSession, d: str) -> DataFrame:
    n_rel = F.count(F.when(F.col("abs_m").isNull(), F.col("rel")))
    counts = log_of(spark, d).groupBy("survey_id").agg(F.count("*").alias("n"), F.count("abs_m").alias("n_abs"), n_rel.alias("n_rel"))
    kind = F.when(F.col("n_abs") + F.col("n_rel") < 0.5 * F.col("n"), "estimated").when(F.col("n_abs") >= F.col("n_rel"), "absolute").otherwise("relative")
    return counts.select("survey_id", kind.alias("reference"), "n_abs", "n_rel")


FRESH = """fresh AS (SELECT * FROM (SELECT *, lag(lat) OVER q AS lat0, lag(lon) OVER q AS lon0, row_number() OVER q AS rn FROM log WHERE lat IS NOT NULL AND lon IS NOT NULL
    WINDOW q AS (PARTITION BY survey_id ORDER BY t, frame_id)) WHERE rn = 1 OR abs(lat - lat0) > 1e-12 OR abs(lon - lon0) > 1e-12)"""


@query("c04_fresh_fixes", f"WITH {LOG}, {FRESH} SELECT survey_id, frame_id FROM fresh")
def c04(spark: SparkSession, d: str) -> DataFrame:
    return T.fresh_fixes(log_of(spark, d), ["lat", "lon"]).select("survey_id", "frame_id")


ASOF = f"""WITH {LOG}, {FRESH}, f AS (SELECT survey_id, t, min(lat) AS lat, min(lon) AS lon FROM fresh GROUP BY survey_id, t),
    k AS (SELECT DISTINCT survey_id, keyframe_no, timestamp_sec AS t FROM frame_index WHERE timestamp_sec IS NOT NULL),
    a AS (SELECT k.*, f.t AS ta, f.lat AS alat, f.lon AS alon FROM k ASOF LEFT JOIN f ON k.survey_id = f.survey_id AND k.t >= f.t),
    b AS (SELECT k.survey_id, k.keyframe_no, f.t AS tb, f.lat AS blat, f.lon AS blon FROM k ASOF LEFT JOIN f ON k.survey_id = f.survey_id AND k.t <= f.t)"""


@query("c06_frame_positions", f"""{ASOF} SELECT survey_id, keyframe_no, round(coalesce(alat + (blat - alat) * CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END, alat, blat) + 1e-9, 7) AS lat,
    round(coalesce(alon + (blon - alon) * CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END, alon, blon) + 1e-9, 7) AS lon,
    coalesce(t - ta, 0) <= 0.5 OR coalesce(tb - t, 0) <= 0.5 AS near FROM a JOIN b USING (survey_id, keyframe_no)""")
def c06(spark: SparkSession, d: str) -> DataFrame:
    frames = T.keyframes(read(spark, d, "frame_index")).select("survey_id", "keyframe_no", F.col("timestamp_sec").alias("t")).distinct()
    found = T.interpolate_at(frames, T.fresh_fixes(log_of(spark, d), ["lat", "lon"]), "keyframe_no", ["lat", "lon"])
    near = (F.coalesce("gap_before", F.lit(0.0)) <= 0.5) | (F.coalesce("gap_after", F.lit(0.0)) <= 0.5)
    return found.select("survey_id", "keyframe_no", F.round(F.col("lat") + 1e-9, 7).alias("lat"), F.round(F.col("lon") + 1e-9, 7).alias("lon"), near.alias("near"))


@query("c07_path_length", f"""WITH {LOG}, {FRESH}, l AS (SELECT survey_id, {hav('lat0', 'lon0', 'lat', 'lon')} AS leg FROM fresh)
    SELECT survey_id, count(*) AS fixes, round(coalesce(sum(leg), 0), 2) AS path_m FROM l WHERE leg IS NULL OR leg < 1000 GROUP BY survey_id""")
def c07(spark: SparkSession, d: str) -> DataFrame:
    legs = T.track_legs(log_of(spark, d)).where("leg_m < 1000")
    return legs.groupBy("survey_id").agg(F.count("*").alias("fixes"), F.round(F.sum("leg_m"), 2).alias("path_m"))


@query("c08_distance_and_bearing", f"""WITH h AS (SELECT DISTINCT survey_id, home_lat AS a, home_lon AS o FROM flight_data WHERE home_lat IS NOT NULL)
    SELECT survey_id, round({hav('a', 'o', '45.3', '29.3')}, 2) AS distance_m, round({course('a', 'o', '45.3', '29.3')}, 5) AS course_deg FROM h""")
def c08(spark: SparkSession, d: str) -> DataFrame:
    home = read(spark, d, "flight_data").where("home_lat IS NOT NULL").select("survey_id", "home_lat", "home_lon").distinct()
    there = (F.col("home_lat"), F.col("home_lon"), F.lit(45.3), F.lit(29.3))
    return home.select("survey_id", F.round(haversine(*there), 2).alias("distance_m"), F.round(bearing(*there), 5).alias("course_deg"))


BOUNDS = "bounds AS (SELECT survey_id, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, avg(lat) AS lat, avg(lon) AS lon, coalesce(avg(rel), 25.0) AS height_m, count(*) AS n FROM log WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (abs(lat) < 1e-9 AND abs(lon) < 1e-9) GROUP BY survey_id)"


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    ok = log_of(spark, d).where(T.is_position(F.col("lat"), F.col("lon")))
    return ok.groupBy("survey_id").agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.coalesce(F.avg("rel"), F.lit(25.0)).alias("height_m"), F.count("*").alias("n"),
    )


@query("c09_log_bounds", f"WITH {LOG}, {BOUNDS} SELECT survey_id, south, north, west, east, round(lat, 6) AS lat, round(lon, 6) AS lon, round(height_m, 4) AS height_m, n FROM bounds")
def c09(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d).select("survey_id", "south", "north", "west", "east", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("height_m", 4).alias("height_m"), "n")


@query("c10_overlap_with_previous", f"""WITH {LOG}, {BOUNDS}, s AS (SELECT DISTINCT survey_id, site FROM flight_data),
    p AS (SELECT site, survey_id, south, north, west, east, lag(survey_id) OVER q AS other, lag(south) OVER q AS s0, lag(north) OVER q AS n0, lag(west) OVER q AS w0, lag(east) OVER q AS e0
          FROM bounds JOIN s USING (survey_id) WINDOW q AS (PARTITION BY site ORDER BY survey_id)),
    o AS (SELECT *, 100.0 / 111000.0 AS m FROM p WHERE other IS NOT NULL)
    SELECT survey_id, other, south <= n0 + m AND s0 <= north + m AND west <= e0 + m AND w0 <= east + m AS overlap,
      round(greatest(0.01, least(1.0, greatest(0.0, least(north, n0) - greatest(south, s0)) * greatest(0.0, least(east, e0) - greatest(west, w0)) / greatest(1e-12, least((north - south) * (east - west), (n0 - s0) * (e0 - w0))))), 5) AS ratio FROM o""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    sites = read(spark, d, "flight_data").select("survey_id", "site").distinct()
    order = Window.partitionBy("site").orderBy("survey_id")  # one row for each survey of a site
    edges = {"other": "survey_id", "s0": "south", "n0": "north", "w0": "west", "e0": "east"}
    pairs = _bounds(spark, d).join(sites, "survey_id").select("*", *[F.lag(c).over(order).alias(n) for n, c in edges.items()]).where("other IS NOT NULL")
    margin = 100.0 / 111000.0
    overlap = (F.col("south") <= F.col("n0") + margin) & (F.col("s0") <= F.col("north") + margin) & (F.col("west") <= F.col("e0") + margin) & (F.col("w0") <= F.col("east") + margin)
    shared = F.greatest(F.lit(0.0), F.least("north", "n0") - F.greatest("south", "s0")) * F.greatest(F.lit(0.0), F.least("east", "e0") - F.greatest("west", "w0"))
    smaller = F.greatest(F.lit(1e-12), F.least((F.col("north") - F.col("south")) * (F.col("east") - F.col("west")), (F.col("n0") - F.col("s0")) * (F.col("e0") - F.col("w0"))))
    return pairs.select("survey_id", "other", overlap.alias("overlap"), F.round(F.greatest(F.lit(0.01), F.least(F.lit(1.0), shared / smaller)), 5).alias("ratio"))


@query("c11_log_matches_mission", f"""WITH {LOG}, m AS (SELECT survey_id, quantile_cont(lat, 0.5) AS a, quantile_cont(lon, 0.5) AS o FROM log WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY survey_id),
    h AS (SELECT survey_id, min(home_lat) AS ha, min(home_lon) AS ho FROM flight_data WHERE home_lat IS NOT NULL GROUP BY survey_id)
    SELECT survey_id, least({hav('ha', 'ho', 'a', 'o')}, {hav('ha', 'ho', 'o', 'a')}) <= 2000 AS matches FROM m JOIN h USING (survey_id)""")
def c11(spark: SparkSession, d: str) -> DataFrame:
    middle = G.quantiles(log_of(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL"), ["survey_id"], a=("lat", 0.5), o=("lon", 0.5))
    home = read(spark, d, "flight_data").where("home_lat IS NOT NULL").groupBy("survey_id").agg(F.min("home_lat").alias("ha"), F.min("home_lon").alias("ho"))
    near = F.least(haversine(F.col("ha"), F.col("ho"), F.col("a"), F.col("o")), haversine(F.col("ha"), F.col("ho"), F.col("o"), F.col("a"))) <= 2000
    return middle.join(home, "survey_id").select("survey_id", near.alias("matches"))


@query("c12_swap_coordinates", f"""WITH {LOG}, o AS (SELECT survey_id, max(CASE WHEN latlon_order = 'lon_lat' THEN 1 ELSE 0 END) AS sw FROM flight_data GROUP BY survey_id)
    SELECT survey_id, frame_id, CASE WHEN sw = 1 THEN lon ELSE lat END AS lat, CASE WHEN sw = 1 THEN lat ELSE lon END AS lon FROM log JOIN o USING (survey_id)""")
def c12(spark: SparkSession, d: str) -> DataFrame:
    swapped = read(spark, d, "flight_data").groupBy("survey_id").agg(F.coalesce(F.bool_or(F.col("latlon_order") == "lon_lat"), F.lit(False)).alias("swapped"))
    pick = lambda a, b: F.when(F.col("swapped"), F.col(a)).otherwise(F.col(b))
    return log_of(spark, d).join(swapped, "survey_id").select("survey_id", "frame_id", pick("lon", "lat").alias("lat"), pick("lat", "lon").alias("lon"))


@query("c14_position_quality", f"""WITH {LOG}, s AS (SELECT survey_id, avg(CAST(rtk_q = 1 AS INT)) AS f, avg(CAST(rtk_q = 2 AS INT)) AS g, count(*) AS n FROM log WHERE rtk_q IS NOT NULL GROUP BY survey_id)
    SELECT survey_id, round(f, 6) AS fixed, round(g, 6) AS floating, n, CASE WHEN f >= 0.9 THEN 'FIXED' WHEN f + g >= 0.9 THEN 'FLOAT' ELSE 'GNSS' END AS source FROM s""")
def c14(spark: SparkSession, d: str) -> DataFrame:
    return T.position_quality(log_of(spark, d)).select("survey_id", F.round("fixed", 6).alias("fixed"), F.round("floating", 6).alias("floating"), "n", "source")


@query("c15_takeoff_elevation", f"""WITH {LOG}, s AS (SELECT survey_id, count(*) AS n, quantile_cont(abs_m - rel, 0.5) AS mid, quantile_cont(abs_m - rel, 0.9) - quantile_cont(abs_m - rel, 0.1) AS spread
    FROM log WHERE abs_m IS NOT NULL AND rel IS NOT NULL GROUP BY survey_id) SELECT survey_id, n, round(CASE WHEN n >= 5 AND abs(mid) > 0.5 AND spread < 5 THEN mid END, 5) AS takeoff_m FROM s""")
def c15(spark: SparkSession, d: str) -> DataFrame:
    return T.takeoff_elevation(log_of(spark, d)).select("survey_id", "n", F.round("takeoff_m", 5).alias("takeoff_m"))


@query("c16_camera_tilt", f"""WITH {LOG}, s AS (SELECT survey_id, quantile_cont(gb_pitch, 0.5) AS mid, quantile_cont(gb_pitch, 0.1) AS low, quantile_cont(gb_pitch, 0.9) AS high FROM log WHERE gb_pitch IS NOT NULL GROUP BY survey_id)
    SELECT survey_id, round(mid, 5) AS mid, round(low, 5) AS low, round(high, 5) AS high, CASE WHEN mid < -75 THEN 'nadir' WHEN mid < -15 THEN 'oblique' ELSE 'level' END AS kind FROM s""")
def c16(spark: SparkSession, d: str) -> DataFrame:
    stats = G.quantiles(log_of(spark, d).where("gb_pitch IS NOT NULL"), ["survey_id"], mid=("gb_pitch", 0.5), low=("gb_pitch", 0.1), high=("gb_pitch", 0.9))
    stats = stats.select("survey_id", *[F.round(c, 5).alias(c) for c in ("mid", "low", "high")])
    return stats.withColumn("kind", F.when(F.col("mid") < -75, "nadir").when(F.col("mid") < -15, "oblique").otherwise("level"))


@query("c17_speed_and_course", f"""WITH {LOG}, w AS (SELECT survey_id, frame_id, t, min(row(t, frame_id, lat, lon)) OVER q AS a, max(row(t, frame_id, lat, lon)) OVER q AS b FROM log WHERE lat IS NOT NULL AND lon IS NOT NULL
      WINDOW q AS (PARTITION BY survey_id ORDER BY CAST(round(t * 1000) AS BIGINT) RANGE BETWEEN 1500 PRECEDING AND 1500 FOLLOWING)),
    v AS (SELECT survey_id, frame_id, b[1] - a[1] AS dt, a[3] AS a3, a[4] AS a4, b[3] AS b3, b[4] AS b4 FROM w), x AS (SELECT *, {hav('a3', 'a4', 'b3', 'b4')} AS m FROM v)
    SELECT survey_id, frame_id, CASE WHEN dt > 1 AND m > 0.05 THEN round(m / dt, 4) END AS speed_ms FROM x""")
def c17(spark: SparkSession, d: str) -> DataFrame:
    return T.readouts(log_of(spark, d)).select("survey_id", "frame_id", F.round("speed_ms", 4).alias("speed_ms"))


@query("c18_pose_at_readings", f"""WITH {LOG}, f AS (SELECT survey_id, timestamp_sec AS t, min(pos_x) AS x, min(pos_y) AS y, min(pos_z) AS z FROM (SELECT DISTINCT survey_id, keyframe_no, timestamp_sec, pos_x, pos_y, pos_z FROM frame_index
      WHERE registered AND timestamp_sec IS NOT NULL AND pos_x IS NOT NULL) GROUP BY survey_id, timestamp_sec),
    k AS (SELECT survey_id, frame_id, t FROM log), a AS (SELECT k.*, f.t AS ta, f.x AS ax, f.y AS ay FROM k ASOF LEFT JOIN f ON k.survey_id = f.survey_id AND k.t >= f.t),
    b AS (SELECT k.survey_id, k.frame_id, k.t AS t1, f.t AS tb, f.x AS bx, f.y AS by_ FROM k ASOF LEFT JOIN f ON k.survey_id = f.survey_id AND k.t <= f.t),
    j AS (SELECT a.*, tb, bx, by_, coalesce(least(coalesce(t - ta, 1e9), coalesce(tb - t, 1e9)) <= 2, false) AS near, CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END AS s FROM a JOIN b ON a.survey_id = b.survey_id AND a.frame_id = b.frame_id AND a.t = b.t1)
    SELECT survey_id, frame_id, round(CASE WHEN near THEN coalesce(ax + (bx - ax) * s, ax, bx) END + 1e-8, 5) AS x, round(CASE WHEN near THEN coalesce(ay + (by_ - ay) * s, ay, by_) END + 1e-8, 5) AS y FROM j""")
def c18(spark: SparkSession, d: str) -> DataFrame:
    poses = T.keyframes(read(spark, d, "frame_index")).where("registered AND pos_x IS NOT NULL").select("survey_id", F.col("timestamp_sec").alias("t"), F.col("pos_x").alias("x"), F.col("pos_y").alias("y"))
    found = T.interpolate_at(log_of(spark, d).select("survey_id", "frame_id", "t"), poses, "frame_id", ["x", "y"], reach=2.0)
    return found.select("survey_id", "frame_id", F.round(F.col("x") + 1e-8, 5).alias("x"), F.round(F.col("y") + 1e-8, 5).alias("y"))


@query("c20_sharp_frames", """WITH f AS (SELECT DISTINCT survey_id, keyframe_no, blur_score FROM frame_index WHERE blur_score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY keyframe_no, blur_score) AS k FROM f)
    SELECT survey_id, keyframe_no FROM r WHERE blur_score > 35 OR k <= 5""")
def c20(spark: SparkSession, d: str) -> DataFrame:
    frames = read(spark, d, "frame_index").where("blur_score IS NOT NULL").select("survey_id", "keyframe_no", "blur_score").distinct()
    return T.first_frames_or_sharp(frames).select("survey_id", "keyframe_no")


@query("c22_log_summary", f"""WITH {LOG}, g AS (SELECT survey_id, count(*) AS n, round(max(t) - min(t), 4) AS seconds, round(quantile_cont(rel, 0.5), 5) AS mid_rel, round(quantile_cont(gb_pitch, 0.5), 5) AS mid_pitch, count(lat) AS n_lat FROM log GROUP BY survey_id),
    f AS (SELECT survey_id, max(waypoint_count) AS said, min(source) AS source FROM flight_data GROUP BY survey_id) SELECT survey_id, n, seconds, mid_rel, mid_pitch, n_lat, said, source FROM g LEFT JOIN f USING (survey_id)""")
def c22(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(spark, d)
    stats = log.groupBy("survey_id").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 4).alias("seconds"), F.count("lat").alias("n_lat"))
    middle = G.quantiles(log, ["survey_id"], mid_rel=("rel", 0.5), mid_pitch=("gb_pitch", 0.5))
    stats = stats.join(middle.select("survey_id", *[F.round(c, 5).alias(c) for c in ("mid_rel", "mid_pitch")]), "survey_id")
    said = read(spark, d, "flight_data").groupBy("survey_id").agg(F.max("waypoint_count").alias("said"), F.min("source").alias("source"))
    return stats.join(said, "survey_id", "left")


@query("b10_subtitle_cues", f"""WITH {LOG}, c AS (SELECT survey_id, frame_id, row_number() OVER q AS cue, CAST(round(t * 1000) AS BIGINT) AS a, CAST(round(coalesce(lead(t) OVER q, t + 1) * 1000) AS BIGINT) AS b FROM log WINDOW q AS (PARTITION BY survey_id ORDER BY t, frame_id))
    SELECT survey_id, frame_id, cue, printf('%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000, b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS span FROM c""")
def b10(spark: SparkSession, d: str) -> DataFrame:
    return T.subtitle_cues(log_of(spark, d))


@query("a17_registered_frames", "SELECT DISTINCT survey_id, keyframe_no, timestamp_sec, pos_x, pos_y, pos_z FROM frame_index WHERE registered AND timestamp_sec IS NOT NULL AND pos_x IS NOT NULL")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return T.keyframes(read(spark, d, "frame_index")).where("registered AND pos_x IS NOT NULL").select("survey_id", "keyframe_no", "timestamp_sec", "pos_x", "pos_y", "pos_z").distinct()


@query("a08_coordinate_order", f"""WITH {LOG} SELECT survey_id, CASE WHEN max(CASE WHEN abs(lat) > 90 AND abs(lat) <= 180 THEN 1 ELSE 0 END) = 1 THEN 'lon_lat' ELSE 'lat_lon' END AS stored,
    max(CASE WHEN (abs(lat) > 90 AND abs(lat) <= 180) OR (abs(lon) > 90 AND abs(lon) <= 180) THEN 1 ELSE 0 END) = 0 AS ambiguous FROM log GROUP BY survey_id""")
def a08(spark: SparkSession, d: str) -> DataFrame:
    over = lambda c: (F.abs(c) > 90) & (F.abs(c) <= 180)
    first, second = F.coalesce(F.bool_or(over("lat")), F.lit(False)), F.coalesce(F.bool_or(over("lon")), F.lit(False))
    return log_of(spark, d).groupBy("survey_id").agg(F.when(first, "lon_lat").otherwise("lat_lon").alias("stored"), (~(first | second)).alias("ambiguous"))


@query("a22_camera_track", """WITH f AS (SELECT DISTINCT survey_id, keyframe_no, pos_x, pos_y, pos_z FROM frame_index WHERE registered AND pos_x IS NOT NULL) SELECT survey_id, count(*) AS n, round(min(pos_x), 4) AS x0, round(max(pos_x), 4) AS x1, round(avg(pos_y), 4) AS y FROM f GROUP BY survey_id HAVING count(*) >= 3""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    track = read(spark, d, "frame_index").where("registered AND pos_x IS NOT NULL").select("survey_id", "keyframe_no", "pos_x", "pos_y", "pos_z").distinct()
    return track.groupBy("survey_id").agg(F.count("*").alias("n"), F.round(F.min("pos_x"), 4).alias("x0"), F.round(F.max("pos_x"), 4).alias("x1"), F.round(F.avg("pos_y"), 4).alias("y")).where("n >= 3")
