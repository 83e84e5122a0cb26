"""Queries over the georeference of camera tracks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import georeference as R
from terravane.operators import telemetry as T
from terravane.plans.geodesy import CHECK, checks
from terravane.plans.telemetry import ASOF, log_of
from terravane.session import cut_lineage, read

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


POS = f"""{ASOF}, pose AS (SELECT DISTINCT survey_id, keyframe_no, pos_x AS x, pos_y AS y, pos_z AS z, fov_y_deg AS fov FROM frame_index WHERE registered AND pos_x IS NOT NULL AND pos_z IS NOT NULL),
    pairs AS (SELECT survey_id, keyframe_no, x, z, alat + (blat - alat) * CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END AS la, alon + (blon - alon) * CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END AS lo
      FROM a JOIN b USING (survey_id, keyframe_no) JOIN pose USING (survey_id, keyframe_no) WHERE least(t - ta, tb - t) <= 0.5),
    two AS (SELECT survey_id, false AS swapped, keyframe_no, x, z, la, lo FROM pairs UNION ALL SELECT survey_id, true, keyframe_no, x, z, lo, la FROM pairs),
    ok AS (SELECT * FROM two WHERE abs(la) <= 90 AND abs(lo) <= 180 AND NOT (abs(la) < 1e-9 AND abs(lo) < 1e-9)),
    mid AS (SELECT survey_id, swapped, avg(la) AS lat0, avg(lo) AS lon0 FROM ok GROUP BY ALL),
    p0 AS (SELECT ok.survey_id, ok.swapped, keyframe_no, x, z, radians(lo - lon0) * cos(radians(lat0)) * 6371000.0 AS e, radians(la - lat0) * 6371000.0 AS n FROM ok JOIN mid USING (survey_id, swapped))"""


def _fit_sql(k: int, source: str) -> str:
    return f"""m{k} AS (SELECT survey_id, swapped, count(*) AS pairs, avg(x) AS mx, avg(z) AS mz, avg(e) AS me, avg(n) AS mn, var_pop(x) + var_pop(z) AS vs, var_pop(e) + var_pop(n) AS vt, covar_pop(x, e) + covar_pop(-z, n) AS p, covar_pop(x, n) - covar_pop(-z, e) AS q FROM {source} GROUP BY survey_id, swapped HAVING count(*) >= 3 AND var_pop(x) + var_pop(z) > 1e-9),
    f{k} AS (SELECT *, p / vs AS a, q / vs AS b, sqrt(greatest(0.0, vt - (p * p + q * q) / vs)) AS rmse, sqrt(vt) AS spread FROM m{k})"""


def _miss_sql(k: int) -> str:
    return f"""d{k} AS (SELECT p0.*, sqrt(pow(e - (me + a * (x - mx) - b * (mz - z)), 2) + pow(n - (mn + b * (x - mx) + a * (mz - z)), 2)) AS miss FROM p{k} p0 JOIN f{k} USING (survey_id, swapped)),
    l{k} AS (SELECT survey_id, swapped, greatest(3.75, 3.0 * quantile_cont(miss, 0.5)) AS most FROM d{k} GROUP BY ALL), p{k + 1} AS (SELECT d{k}.survey_id, d{k}.swapped, keyframe_no, x, z, e, n FROM d{k} JOIN l{k} USING (survey_id, swapped) WHERE miss <= most)"""


# each round starts from all pairs again, as an early fit may have been pulled off
FITS = f"""{POS}, {_fit_sql(0, 'p0')}, {_miss_sql(0)}, {_fit_sql(1, 'p1')},
    d1 AS (SELECT p0.*, sqrt(pow(e - (me + a * (x - mx) - b * (mz - z)), 2) + pow(n - (mn + b * (x - mx) + a * (mz - z)), 2)) AS miss FROM p0 JOIN f1 USING (survey_id, swapped)),
    l1 AS (SELECT survey_id, swapped, greatest(3.75, 3.0 * quantile_cont(miss, 0.5)) AS most FROM d1 GROUP BY ALL), p2 AS (SELECT d1.survey_id, d1.swapped, keyframe_no, x, z, e, n FROM d1 JOIN l1 USING (survey_id, swapped) WHERE miss <= most),
    {_fit_sql(2, 'p2')}, fits AS (SELECT * FROM f2 JOIN mid USING (survey_id, swapped)),
    o AS (SELECT survey_id, max(CASE WHEN NOT swapped THEN rmse END) AS rmse, max(CASE WHEN swapped THEN rmse END) AS rmse_swapped FROM fits GROUP BY survey_id), pick AS (SELECT *, coalesce(rmse_swapped < 0.6 * rmse, rmse IS NULL) AS swapped FROM o),
    best AS (SELECT fits.*, fits.rmse / greatest(1e-6, spread * sqrt(least(pairs, 10))) AS doubt FROM fits JOIN pick ON pick.survey_id = fits.survey_id AND pick.swapped = fits.swapped)"""
GRADE = "CASE WHEN doubt < 0.01 THEN 'HIGH' WHEN doubt < 0.05 THEN 'MEDIUM' ELSE 'LOW' END"


def poses(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "frame_index").where("registered AND pos_x IS NOT NULL AND pos_z IS NOT NULL")
    return f.select("survey_id", "keyframe_no", F.col("pos_x").alias("x"), F.col("pos_y").alias("y"), F.col("pos_z").alias("z"), F.col("fov_y_deg").alias("fov")).distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Registered keyframes with the logged position at their time, where a fix is at most half a second away."""
    frames = T.keyframes(read(spark, d, "frame_index")).select("survey_id", "keyframe_no", F.col("timestamp_sec").alias("t")).distinct()
    at = T.interpolate_at(frames, T.fresh_fixes(log_of(spark, d), ["lat", "lon"]), "keyframe_no", ["lat", "lon"])
    at = at.where((F.col("gap_before") >= 0) & (F.col("gap_after") >= 0) & (F.least("gap_before", "gap_after") <= 0.5))
    return at.select("survey_id", "keyframe_no", "lat", "lon").join(poses(spark, d).select("survey_id", "keyframe_no", "x", "z"), ["survey_id", "keyframe_no"])


def fits(spark: SparkSession, d: str) -> DataFrame:
    return R.order_fits(cut_lineage(pairs(spark, d)))


@query("d19_order_test", f"{FITS} SELECT survey_id, round(rmse, 2) AS rmse_m, round(rmse_swapped, 2) AS rmse_swapped_m, swapped FROM pick")
def d19(spark: SparkSession, d: str) -> DataFrame:
    """Which order of the stored coordinates fits the camera track."""
    return R.chosen_order(fits(spark, d)).select("survey_id", F.round("rmse", 2).alias("rmse_m"), F.round("rmse_swapped", 2).alias("rmse_swapped_m"), "swapped")


@query("d18_georeference", f"""{FITS}, v AS (SELECT survey_id, count(coalesce(absolute_altitude_m, relative_altitude_m)) AS k FROM waypoints GROUP BY survey_id)
    SELECT v.survey_id, CASE WHEN pairs IS NOT NULL THEN 'GPS' WHEN k > 0 THEN 'ALTITUDE_AGL' ELSE 'ASSUMED_ALTITUDE' END AS mode, coalesce({GRADE.replace('ELSE', "WHEN doubt IS NOT NULL THEN")}, 'LOW') AS confidence, pairs, round(sqrt(a * a + b * b), 4) AS scale, round(degrees(atan2(b, a)), 3) AS turn_deg, round(rmse, 2) AS rmse_m FROM v LEFT JOIN best USING (survey_id)""")
def d18(spark: SparkSession, d: str) -> DataFrame:
    """Scale, turn and confidence of each survey; by altitude only where the log gives no positions."""
    has = read(spark, d, "waypoints").groupBy("survey_id").agg(F.count(F.coalesce("absolute_altitude_m", "relative_altitude_m")).alias("k"))
    found = has.join(R.solved(fits(spark, d)), "survey_id", "left")
    mode = F.when(F.col("pairs").isNotNull(), "GPS").when(F.col("k") > 0, "ALTITUDE_AGL").otherwise("ASSUMED_ALTITUDE")
    return found.select("survey_id", mode.alias("mode"), F.coalesce("confidence", F.lit("LOW")).alias("confidence"), "pairs", F.round("scale", 4).alias("scale"), F.round("turn_deg", 3).alias("turn_deg"), F.round("rmse", 2).alias("rmse_m"))


PLACED = "placed AS (SELECT pose.survey_id, keyframe_no, x, y, z, fov, pairs, a, b, lat0, lon0, me + a * (x - mx) - b * (mz - z) AS e, mn + b * (x - mx) + a * (mz - z) AS n FROM pose JOIN best USING (survey_id))"


def placed(spark: SparkSession, d: str) -> DataFrame:
    e, n = R.fitted()
    return poses(spark, d).join(R.solved(fits(spark, d)).drop("swapped"), "survey_id").withColumn("e", e).withColumn("n", n)


@query("d20_recalibrated_track", f"{FITS}, {PLACED} SELECT survey_id, keyframe_no, round(lat0 + degrees(n / 6371000.0), 6) AS lat, round(lon0 + degrees(e / (6371000.0 * cos(radians(lat0)))), 6) AS lon FROM placed")
def d20(spark: SparkSession, d: str) -> DataFrame:
    """Positions of all registered keyframes under the fit of their survey."""
    lat, lon = R.geodetic(F.col("e"), F.col("n"))
    return placed(spark, d).select("survey_id", "keyframe_no", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("d21_pose_export", f"""{FITS}, {PLACED} SELECT survey_id, keyframe_no, round(e, 2) AS e, round(n, 2) AS n, round(y * sqrt(a * a + b * b), 2) AS h, round(sin(atan2(b, a) / 2), 5) AS qy, round(cos(atan2(b, a) / 2), 5) AS qw, round(fov, 4) AS fov_y_deg FROM placed""")
def d21(spark: SparkSession, d: str) -> DataFrame:
    """Camera centre in the metric frame, the turn of its frame as a quaternion, vertical field of view."""
    half = F.atan2("b", "a") / 2
    return placed(spark, d).select("survey_id", "keyframe_no", F.round("e", 2).alias("e"), F.round("n", 2).alias("n"), F.round(F.col("y") * F.hypot("a", "b"), 2).alias("h"), F.round(F.sin(half), 5).alias("qy"), F.round(F.cos(half), 5).alias("qw"), F.round("fov", 4).alias("fov_y_deg"))


@query("d22_pair_scales", f"""{FITS}, q AS (SELECT p0.* FROM p0 JOIN pick ON pick.survey_id = p0.survey_id AND pick.swapped = p0.swapped),
    r AS (SELECT u.survey_id, sqrt(pow(u.e - w.e, 2) + pow(u.n - w.n, 2)) / sqrt(pow(u.x - w.x, 2) + pow(u.z - w.z, 2)) AS r FROM q u JOIN q w ON w.survey_id = u.survey_id AND w.keyframe_no - u.keyframe_no IN (7, 23) WHERE sqrt(pow(u.x - w.x, 2) + pow(u.z - w.z, 2)) >= 5.0)
    SELECT survey_id, count(*) AS n, round(quantile_cont(r, 0.5), 4) AS ratio FROM r GROUP BY survey_id""")
def d22(spark: SparkSession, d: str) -> DataFrame:
    """Median ratio of logged and model distances of keyframes 7 and 23 apart: a check of the scale without a fit."""
    p = cut_lineage(pairs(spark, d))
    keys = ["survey_id", "swapped"]
    metres = R.local_metres(R.both_orders(p), keys, "lat", "lon")
    order = R.chosen_order(R.order_fits(p)).select(*keys)
    found = R.pair_scales(metres.join(order, keys), "keyframe_no", (7, 23), 5.0)
    return found.select("survey_id", "n", F.round("ratio", 4).alias("ratio"))


@query("d23_control_correction", f"WITH {CHECK}, m AS (SELECT survey, avg(de) AS e, avg(dn) AS n, avg(dh) AS h FROM chk GROUP BY survey) SELECT survey, id, round(de - e, 5) AS de, round(dn - n, 5) AS dn, round(dh - h, 5) AS dh, round(e, 5) AS shift_de FROM chk JOIN m USING (survey)")
def d23(spark: SparkSession, d: str) -> DataFrame:
    """Residuals of check points after their mean has moved the origin."""
    out = R.control_corrected(checks(spark, d), ["survey"], ["de", "dn", "dh"])
    return out.select("survey", "id", *[F.round(c, 5).alias(c) for c in ("de", "dn", "dh", "shift_de")])


@query("d24_scaled_intrinsics", """WITH c AS (SELECT DISTINCT survey_id, fov_y_deg AS fov FROM frame_index WHERE fov_y_deg IS NOT NULL), k AS (SELECT survey_id, fov, 2160 / (2 * tan(radians(fov) / 2)) AS f FROM c)
    SELECT survey_id, round(fov, 4) AS fov, round(f * 1920 / 3840, 4) AS fx, round(f * 1080 / 2160, 4) AS fy, 960.0 AS cx, 540.0 AS cy FROM k""")
def d24(spark: SparkSession, d: str) -> DataFrame:
    """Camera matrices of 3840 x 2160 frames for frames of half that size."""
    c = read(spark, d, "frame_index").where("fov_y_deg IS NOT NULL").select("survey_id", F.col("fov_y_deg").alias("fov")).distinct()
    f = F.lit(2160.0) / (2 * F.tan(F.radians("fov") / 2))
    full = c.select("survey_id", "fov", F.lit(3840).alias("width"), F.lit(2160).alias("height"), f.alias("fx"), f.alias("fy"), F.lit(1920.0).alias("cx"), F.lit(1080.0).alias("cy"))
    return R.scaled_intrinsics(full, 1920, 1080).select("survey_id", F.round("fov", 4).alias("fov"), F.round("fx", 4).alias("fx"), F.round("fy", 4).alias("fy"), "cx", "cy")
