"""Queries over geodesy, fits and accuracy, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geodesy as D
from terravane.operators import fitting
from terravane.operators import telemetry as T
from terravane.plans.telemetry import LOG, log_of
from terravane.session import read

QUERIES, ORACLE = {}, {}
ORIGIN = (45.3, 29.3, 20.0)


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


FIX = f"{LOG}, fix AS (SELECT survey_id, frame_id, CASE WHEN abs(lat) > 90 THEN lon ELSE lat END AS la, CASE WHEN abs(lat) > 90 THEN lat ELSE lon END AS lo, coalesce(abs_m, rel) AS h FROM log WHERE lat BETWEEN -180 AND 180 AND lon BETWEEN -180 AND 180 AND coalesce(abs_m, rel) BETWEEN -500 AND 9000 AND NOT (abs(lat) > 90 AND abs(lon) > 90))"
N = f"({D.A!r} / sqrt(1 - {D.E2!r} * pow(sin(radians(la)), 2)))"
ECEF = f"ecef AS (SELECT *, ({N} + h) * cos(radians(la)) * cos(radians(lo)) AS x, ({N} + h) * cos(radians(la)) * sin(radians(lo)) AS y, ({N} * (1 - {D.E2!r}) + h) * sin(radians(la)) AS z FROM fix)"


def fixes(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("lat").between(-180, 180) & F.col("lon").between(-180, 180) & F.coalesce("abs_m", "rel").between(-500, 9000) & ~((F.abs("lat") > 90) & (F.abs("lon") > 90))
    swapped = F.abs("lat") > 90
    return log_of(spark, d).where(ok).select(
        "survey_id", "frame_id", F.when(swapped, F.col("lon")).otherwise(F.col("lat")).alias("la"), F.when(swapped, F.col("lat")).otherwise(F.col("lon")).alias("lo"), F.coalesce("abs_m", "rel").alias("h")
    )


@query("d01_geocentric", f"WITH {FIX}, {ECEF} SELECT survey_id, frame_id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM ecef")
def d01(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = D.to_ecef(F.col("la"), F.col("lo"), F.col("h"))
    return fixes(spark, d).select("survey_id", "frame_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


def _enu_sql() -> str:
    base, axes = D.ecef_point(*ORIGIN), D.enu_axes(*ORIGIN[:2])
    row = lambda r: " + ".join(f"({w!r}) * ({c} - ({o!r}))" for w, c, o in zip(r, "xyz", base))
    return f"enu AS (SELECT survey_id, frame_id, {row(axes[0])} AS e, {row(axes[1])} AS n, {row(axes[2])} AS u FROM ecef)"


@query("d02_local_frame", f"WITH {FIX}, {ECEF}, {_enu_sql()} SELECT survey_id, frame_id, round(e, 2) AS e, round(n, 2) AS n, round(u, 2) AS u FROM enu")
def d02(spark: SparkSession, d: str) -> DataFrame:
    e, n, u = D.to_enu(F.col("la"), F.col("lo"), F.col("h"), ORIGIN)
    return fixes(spark, d).select("survey_id", "frame_id", F.round(e, 2).alias("e"), F.round(n, 2).alias("n"), F.round(u, 2).alias("u"))


@query("d03_back_to_geodetic", f"WITH {FIX} SELECT survey_id, frame_id, round(la, 7) AS lat, round(lo, 7) AS lon, round(h, 3) AS h FROM fix")
def d03(spark: SparkSession, d: str) -> DataFrame:
    """Round trip through geocentric coordinates."""
    la, lo, h = D.from_ecef(*D.to_ecef(F.col("la"), F.col("lo"), F.col("h")))
    return fixes(spark, d).select("survey_id", "frame_id", F.round(la, 7).alias("lat"), F.round(lo, 7).alias("lon"), F.round(h, 3).alias("h"))


@query("d04_frame_to_frame")
def d04(spark: SparkSession, d: str) -> DataFrame:
    """Positions of one tangent frame in that of another origin."""
    turn, shift = D.enu_to_enu(ORIGIN, (45.31, 29.32, 5.0))
    e, n, u = D.affine(*D.to_enu(F.col("la"), F.col("lo"), F.col("h"), ORIGIN), turn, shift)
    return fixes(spark, d).select("survey_id", "frame_id", F.round(e, 2).alias("e"), F.round(n, 2).alias("n"), F.round(u, 2).alias("u"))


HOME = "home AS (SELECT DISTINCT survey_id, home_lat AS la, home_lon AS lo FROM flight_data WHERE home_lat IS NOT NULL)"
ZONE = "CASE WHEN la >= 56 AND la < 64 AND lo >= 3 AND lo < 12 THEN 32 ELSE greatest(1, least(60, CAST(floor((lo + 180) / 6) AS INT) + 1)) END"


def home(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "flight_data").where("home_lat IS NOT NULL").select("survey_id", F.col("home_lat").alias("la"), F.col("home_lon").alias("lo")).distinct()


@query("d05_utm_zone", f"WITH {HOME} SELECT survey_id, {ZONE} AS zone, CASE WHEN la >= 0 THEN 32600 ELSE 32700 END + {ZONE} AS epsg FROM home")
def d05(spark: SparkSession, d: str) -> DataFrame:
    zone = D.utm_zone(F.col("la"), F.col("lo"))
    return home(spark, d).select("survey_id", zone.alias("zone"), D.utm_epsg(zone, F.col("la")).alias("epsg"))


def _utm_sql() -> str:
    a = D.series(D.FORWARD_SERIES)
    t = f"sinh(atanh(sin(radians(la))) - {D.ECC!r} * atanh({D.ECC!r} * sin(radians(la))))"
    xi = " + ".join(["xi0"] + [f"({c!r}) * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, c in enumerate(a, 1)])
    eta = " + ".join(["eta0"] + [f"({c!r}) * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, c in enumerate(a, 1)])
    k = D.K0 * D.RADIUS
    return f"""z AS (SELECT *, {ZONE} AS zone FROM home), t AS (SELECT *, {t} AS t, radians(lo) - radians((zone - 1) * 6.0 - 177.0) AS lam FROM z),
    s AS (SELECT *, atan2(t, cos(lam)) AS xi0, atanh(sin(lam) / sqrt(1 + t * t)) AS eta0 FROM t), u AS (SELECT survey_id, zone, 500000.0 + {k!r} * ({eta}) AS east, {k!r} * ({xi}) + CASE WHEN la >= 0 THEN 0 ELSE 10000000 END AS north FROM s)"""


@query("d06_utm", f"WITH {HOME}, {_utm_sql()} SELECT survey_id, zone, round(east, 3) AS east, round(north, 3) AS north FROM u")
def d06(spark: SparkSession, d: str) -> DataFrame:
    zone = D.utm_zone(F.col("la"), F.col("lo"))
    east, north = D.utm_forward(F.col("la"), F.col("lo"), zone)
    return home(spark, d).select("survey_id", zone.alias("zone"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("d06_utm_inverse", f"WITH {HOME} SELECT survey_id, round(la, 8) AS lat, round(lo, 8) AS lon FROM home")
def d06b(spark: SparkSession, d: str) -> DataFrame:
    """Round trip through UTM."""
    h = home(spark, d).withColumn("zone", D.utm_zone(F.col("la"), F.col("lo")))
    east, north = D.utm_forward(F.col("la"), F.col("lo"), F.col("zone"))
    lat, lon = D.utm_inverse(east, north, F.col("zone"), F.col("la") >= 0)
    return h.select("survey_id", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query("d07_survey_frame", f"""WITH {HOME}, {LOG}, t AS (SELECT survey_id, CASE WHEN count(*) >= 5 AND abs(quantile_cont(abs_m - rel, 0.5)) > 0.5 AND quantile_cont(abs_m - rel, 0.9) - quantile_cont(abs_m - rel, 0.1) < 5 THEN quantile_cont(abs_m - rel, 0.5) END AS auto FROM log WHERE abs_m IS NOT NULL AND rel IS NOT NULL GROUP BY survey_id),
    r AS (SELECT survey_id, min(altitude_reference) AS ref FROM flight_data GROUP BY survey_id) SELECT h.survey_id, {ZONE} AS zone, CASE WHEN ref = 'absolute' THEN 'absolute' WHEN auto IS NOT NULL THEN 'takeoff' ELSE 'relative' END AS datum, round(CASE WHEN ref = 'absolute' THEN 0 ELSE coalesce(auto, 0) END, 5) AS offset_m FROM home h LEFT JOIN t USING (survey_id) LEFT JOIN r USING (survey_id)""")
def d07(spark: SparkSession, d: str) -> DataFrame:
    """Zone and vertical datum of a survey: absolute logs first, then a steady take-off elevation."""
    auto = T.takeoff_elevation(log_of(spark, d)).select("survey_id", F.col("takeoff_m").alias("auto"))
    ref = read(spark, d, "flight_data").groupBy("survey_id").agg(F.min("altitude_reference").alias("ref"))
    h = home(spark, d).join(auto, "survey_id", "left").join(ref, "survey_id", "left")
    absolute = F.coalesce(F.col("ref") == "absolute", F.lit(False))
    datum = F.when(absolute, "absolute").when(F.col("auto").isNotNull(), "takeoff").otherwise("relative")
    return h.select("survey_id", D.utm_zone(F.col("la"), F.col("lo")).alias("zone"), datum.alias("datum"), F.round(F.when(absolute, 0.0).otherwise(F.coalesce("auto", F.lit(0.0))), 5).alias("offset_m"))


POSE = "pose AS (SELECT DISTINCT survey_id, keyframe_no, pos_x AS x, pos_y AS y, pos_z AS z FROM frame_index WHERE registered AND pos_x IS NOT NULL)"


def poses(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "frame_index").where("registered AND pos_x IS NOT NULL").select("survey_id", "keyframe_no", F.col("pos_x").alias("x"), F.col("pos_y").alias("y"), F.col("pos_z").alias("z")).distinct()


@query("d08_affine", f"WITH {POSE} SELECT survey_id, keyframe_no, round(2 * z + 1, 5) AS x, round(2 * y - 3, 5) AS y, round(-2 * x + 5, 5) AS z FROM pose")
def d08(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = D.affine(F.col("x"), F.col("y"), F.col("z"), [[0, 0, 2], [0, 2, 0], [-2, 0, 0]], [1, -3, 5])
    return poses(spark, d).select("survey_id", "keyframe_no", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(z, 5).alias("z"))


@query("d09_model_to_geodetic")
def d09(spark: SparkSession, d: str) -> DataFrame:
    """Model axes (x east, y up, z south) to latitude and longitude of seven decimals."""
    lat, lon, h = D.from_enu(F.col("x"), -F.col("z"), F.col("y"), ORIGIN)
    return poses(spark, d).select("survey_id", "keyframe_no", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(h, 3).alias("h"))


@query("d10_quaternions", f"WITH {POSE} SELECT survey_id, keyframe_no, round(abs(sin(radians(x) / 2)), 6) AS qy, round(abs(cos(radians(x) / 2)), 6) AS qw FROM pose")
def d10(spark: SparkSession, d: str) -> DataFrame:
    """Quaternion of a turn about the vertical through its matrix and back."""
    half = F.radians("x") / 2
    m = D.quaternion_matrix(F.lit(0.0), F.sin(half), F.lit(0.0), F.cos(half))
    _, qy, _, qw = D.matrix_quaternion(m)
    return poses(spark, d).select("survey_id", "keyframe_no", F.round(F.abs(qy), 6).alias("qy"), F.round(F.abs(qw), 6).alias("qw"))


def fit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Keyframe positions against a turned, scaled and moved copy of them."""
    c, s = math.cos(0.7), math.sin(0.7)
    return poses(spark, d).select("*", (1.4 * (c * F.col("x") - s * F.col("z")) + 12).alias("tx"), (1.4 * (s * F.col("x") + c * F.col("z")) - 7).alias("tz"))


@query("d11_similarity_fit", f"WITH {POSE} SELECT survey_id, keyframe_no, round(1.4 * (cos(0.7) * x - sin(0.7) * z) + 12, 4) AS fx, round(1.4 * (sin(0.7) * x + cos(0.7) * z) - 7, 4) AS fz FROM pose")
def d11(spark: SparkSession, d: str) -> DataFrame:
    """The fit from aggregated moments, applied again: it must give the target back."""
    pairs = fit_pairs(spark, d)
    fit = fitting.similarity_fit(pairs, ["x", "z"], ["tx", "tz"])
    return fitting.apply_fit(pairs, ["x", "z"], fit, ["fx", "fz"]).select("survey_id", "keyframe_no", F.round("fx", 4).alias("fx"), F.round("fz", 4).alias("fz"))


@query("d13_trimmed_fit")
def d13(spark: SparkSession, d: str) -> DataFrame:
    """Fit that drops outliers; every twentieth target is wrong by 90 m."""
    pairs = fit_pairs(spark, d).withColumn("tx", F.col("tx") + F.when(F.col("keyframe_no") % 20 == 0, 90.0).otherwise(0.0))
    (scale, rotation, shift), n = fitting.trimmed_fit(pairs, ["x", "z"], ["tx", "tz"])
    return spark.range(1).select(F.lit(round(scale, 6)).alias("scale"), F.lit(round(math.degrees(math.atan2(rotation[1][0], rotation[0][0])), 5)).alias("turn_deg"), F.lit(round(float(shift[0]), 4)).alias("shift_x"), F.lit(n).alias("pairs"))


@query("d17_ground_mode")
def d17(spark: SparkSession, d: str) -> DataFrame:
    from terravane.plans.fixtures import points

    found = fitting.ground_mode(points(spark, d), "y")
    return spark.range(1).select(F.lit(found).cast("double").alias("ground_m"))


CHECK = "chk AS (SELECT s_nationkey AS survey, s_suppkey AS id, s_acctbal / 1000.0 AS de, (s_suppkey % 17) / 10.0 - 0.8 AS dn, s_acctbal / 2000.0 - 1 AS dh FROM supplier)"


def checks(spark: SparkSession, d: str) -> DataFrame:
    """Residuals of check points, from the supplier table."""
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("survey"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000.0).alias("de"), ((F.col("s_suppkey") % 17) / 10.0 - 0.8).cast("double").alias("dn"), (F.col("s_acctbal") / 2000.0 - 1).alias("dh"))


@query("k01_check_residuals", f"WITH {CHECK} SELECT survey, id, round(sqrt(de * de + dn * dn), 6) AS horizontal, round(dh, 6) AS dh FROM chk")
def k01(spark: SparkSession, d: str) -> DataFrame:
    return checks(spark, d).select("survey", "id", F.round(F.hypot("de", "dn"), 6).alias("horizontal"), F.round("dh", 6).alias("dh"))


@query("k02_leave_one_out", f"WITH {CHECK} SELECT survey, id, round(CASE WHEN count(*) OVER w > 1 THEN de - (sum(de) OVER w - de) / (count(*) OVER w - 1) END + 1e-9, 5) AS loo FROM chk WINDOW w AS (PARTITION BY survey)")
def k02(spark: SparkSession, d: str) -> DataFrame:
    """Residual against the mean of the survey's other points; sums come from one aggregation."""
    c = checks(spark, d)
    sums = c.groupBy("survey").agg(F.sum("de").alias("s"), F.count("*").alias("n"))
    loo = F.when(F.col("n") > 1, F.col("de") - (F.col("s") - F.col("de")) / (F.col("n") - 1))
    return c.join(sums, "survey").select("survey", "id", F.round(loo + 1e-9, 5).alias("loo"))


@query("k03_check_statistics", f"WITH {CHECK} SELECT survey, count(*) AS n, round(sqrt(avg(de * de)), 6) AS rmse_e, round(sqrt(avg(dn * dn)), 6) AS rmse_n, round(sqrt(avg(dh * dh)), 6) AS rmse_h, round(max(sqrt(de * de + dn * dn)), 6) AS worst FROM chk GROUP BY survey")
def k03(spark: SparkSession, d: str) -> DataFrame:
    rms = lambda c: F.round(F.sqrt(F.avg(F.col(c) * F.col(c))), 6)
    return checks(spark, d).groupBy("survey").agg(F.count("*").alias("n"), rms("de").alias("rmse_e"), rms("dn").alias("rmse_n"), rms("dh").alias("rmse_h"), F.round(F.max(F.hypot("de", "dn")), 6).alias("worst"))


@query("k05_position_source", """WITH r AS (SELECT DISTINCT * FROM rtk_summary), b AS (SELECT * FROM (VALUES ('RTK_FIXED', 0.03, 0.05), ('PPK_FIXED', 0.03, 0.05), ('RTK_FLOAT', 0.5, 0.8), ('PPK_FLOAT', 0.5, 0.8)) t(position_source, bias_h, bias_v))
    SELECT survey_id, position_source, coalesce(bias_h, 1.5) AS bias_h, coalesce(bias_v, 3.0) AS bias_v FROM r LEFT JOIN b USING (position_source)""")
def k05(spark: SparkSession, d: str) -> DataFrame:
    """Bias budget of each position source; the table is fixed, four rows."""
    bias = spark.createDataFrame([("RTK_FIXED", 0.03, 0.05), ("PPK_FIXED", 0.03, 0.05), ("RTK_FLOAT", 0.5, 0.8), ("PPK_FLOAT", 0.5, 0.8)], "position_source string, bias_h double, bias_v double")
    r = read(spark, d, "rtk_summary").distinct()
    return r.join(F.broadcast(bias), "position_source", "left").select("survey_id", "position_source", F.coalesce("bias_h", F.lit(1.5)).alias("bias_h"), F.coalesce("bias_v", F.lit(3.0)).alias("bias_v"))


@query("k06_quality_report", """WITH w AS (SELECT survey_id, count(DISTINCT frame_id) AS waypoints FROM waypoints GROUP BY survey_id), k AS (SELECT survey_id, count(DISTINCT keyframe_no) AS frames, count(DISTINCT CASE WHEN registered THEN keyframe_no END) AS registered FROM frame_index GROUP BY survey_id), r AS (SELECT survey_id, min(position_source) AS source FROM rtk_summary GROUP BY survey_id)
    SELECT survey_id, waypoints, frames, registered, round(100.0 * registered / frames, 4) AS registered_pct, coalesce(source, 'GNSS') AS source FROM w LEFT JOIN k USING (survey_id) LEFT JOIN r USING (survey_id)""")
def k06(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "waypoints").groupBy("survey_id").agg(F.count_distinct("frame_id").alias("waypoints"))
    k = read(spark, d, "frame_index").groupBy("survey_id").agg(F.count_distinct("keyframe_no").alias("frames"), F.count_distinct(F.when(F.col("registered"), F.col("keyframe_no"))).alias("registered"))
    r = read(spark, d, "rtk_summary").groupBy("survey_id").agg(F.min("position_source").alias("source"))
    return w.join(k, "survey_id", "left").join(r, "survey_id", "left").select("survey_id", "waypoints", "frames", "registered", F.round(100.0 * F.col("registered") / F.col("frames"), 4).alias("registered_pct"), F.coalesce("source", F.lit("GNSS")).alias("source"))


@query("k07_calibration_summary", "SELECT DISTINCT survey_id, kind, position_source, epochs, round(fix_pct + float_pct, 4) AS solved_pct FROM rtk_summary")
def k07(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "rtk_summary").select("survey_id", "kind", "position_source", "epochs", F.round(F.col("fix_pct") + F.col("float_pct"), 4).alias("solved_pct")).distinct()
