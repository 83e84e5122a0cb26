"""Queries over log readers: texts rendered from the tables and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.plans.telemetry import LOG, log_of
from terravane.sources import logs

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


OK = "lat IS NOT NULL AND lon IS NOT NULL AND rel IS NOT NULL AND abs(lat) < 1000 AND abs(lon) < 1000 AND NOT (abs(lat) < 0.001 AND abs(lon) < 0.001)"
ONE = f"one AS (SELECT survey_id, frame_id, min(t) AS t, min(lat) AS lat, min(lon) AS lon, min(rel) AS rel FROM log WHERE {OK} AND frame_id IS NOT NULL GROUP BY ALL)"


def one(spark: SparkSession, d: str) -> DataFrame:
    """One usable reading for each frame."""
    return log_of(spark, d).where(OK).where("frame_id IS NOT NULL").groupBy("survey_id", "frame_id").agg(*[F.min(c).alias(c) for c in ("t", "lat", "lon", "rel")])


def with_header(rows: DataFrame, header: str) -> DataFrame:
    """Lines of the rows (file, line_no, value) behind a header line for each file."""
    return rows.unionByName(rows.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("line_no"), F.lit(header).alias("value")))


@query("a09_third_value", f"WITH {LOG}, s AS (SELECT survey_id, min(rtk_q) AS q FROM log GROUP BY survey_id) SELECT survey_id AS file, q IS NULL AS altitude FROM s")
def a09(spark: SparkSession, d: str) -> DataFrame:
    """Files whose third GPS value is a height: here those of surveys without any solution quality."""
    s = log_of(spark, d).groupBy("survey_id").agg(F.min("rtk_q").alias("q"))
    each = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9))))
    third = F.when(F.col("q").isNull(), F.format_string("%.1f", 70 + F.col("k") / 10.0)).otherwise(F.format_string("%d", 10 + F.col("k")))
    return logs.third_is_altitude(each.select(F.col("survey_id").alias("file"), third.alias("third"), F.lit(31.5).alias("barometer")))


@query("a10_trajectory_csv", f"""WITH {LOG}, {ONE}, r AS (SELECT *, min(frame_id) OVER (PARTITION BY survey_id) AS f0, max(frame_id) OVER (PARTITION BY survey_id) AS f1, count(*) OVER (PARTITION BY survey_id) AS k FROM one)
    SELECT survey_id AS file, count(*) AS n, round(sum(round(t * 1000)) / 1000, 3) AS seconds, round(avg(round(lat, 7)), 5) AS lat, round(sum(round(rel, 3)), 3) AS alt FROM r WHERE k > 1 AND ((frame_id - f0) % 10 = 0 OR frame_id = f1) GROUP BY survey_id""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """Trajectory tables in milliseconds, and their tenth rows read back."""
    rows = one(spark, d)
    rows = rows.join(rows.groupBy("survey_id").agg(F.count("*").alias("k")).where("k > 1").select("survey_id"), "survey_id", "left_semi")
    lines = rows.select(F.col("survey_id").alias("file"), F.col("frame_id").alias("line_no"), F.format_string("%.0f;%.7f;%.7f;%.3f", F.round(F.col("t") * 1000), F.round("lat", 7), F.round("lon", 7), F.round("rel", 3)).alias("value"))
    back = logs.trajectory_csv(with_header(lines, "Timestamp;Latitude;LONGITUDE;alt"))
    return back.groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum("t_s"), 3).alias("seconds"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.sum("alt_m"), 3).alias("alt"))


@query("a11_telemetry_json", f"WITH {LOG}, {ONE} SELECT survey_id || '#' || CAST(CAST(floor(frame_id / 500) AS BIGINT) AS VARCHAR) AS file, count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS frames, round(sum(round(t, 3)), 3) AS seconds FROM one GROUP BY ALL")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """Waypoint documents, five hundred frames each, read back."""
    w = F.struct("frame_id", F.round("t", 3).alias("time_s"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("rel").alias("relative_altitude_m"))
    part = F.concat_ws("#", "survey_id", F.floor(F.col("frame_id") / 500).cast("string"))
    texts = one(spark, d).groupBy(part.alias("file")).agg(F.to_json(F.struct(F.lit("x").alias("georeference"), F.collect_list(w).alias("waypoints"))).alias("value"))
    return logs.telemetry_json(texts).groupBy("file").agg(F.count("*").alias("n"), F.sum("frame_id").alias("frames"), F.round(F.sum("time_s"), 3).alias("seconds"))


@query("a15_intrinsics", "SELECT DISTINCT survey_id AS file, 'PINHOLE' AS model, 3840.0 AS width, 2160.0 AS height, round(2160 / (2 * tan(radians(fov_y_deg) / 2)), 3) AS fy FROM frame_index WHERE fov_y_deg IS NOT NULL")
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Camera lists rendered from the fields of view and read back."""
    from terravane.session import read

    c = read(spark, d, "frame_index").where("fov_y_deg IS NOT NULL").select("survey_id", (F.lit(2160.0) / (2 * F.tan(F.radians("fov_y_deg") / 2))).alias("f")).distinct()
    text = F.format_string("# Camera list\n1 PINHOLE 3840 2160 %.3f %.3f 1920 1080\n", F.round("f", 3), F.round("f", 3))
    return logs.intrinsics(c.select(F.col("survey_id").alias("file"), text.alias("value"))).select("file", "model", "width", "height", F.round("fy", 3).alias("fy"))


@query("a16_flight_record_csv", f"""WITH {LOG}, {ONE}, z AS (SELECT survey_id, coalesce(min(CASE WHEN frame_id % 7 = 3 THEN round(t * 1000) END), min(round(t * 1000))) AS z FROM one GROUP BY survey_id)
    SELECT survey_id AS file, count(*) AS n, round(sum((round(t * 1000) - z) / 1000), 3) AS seconds, round(sum(round(rel, 3) * 0.3048), 3) AS height FROM one JOIN z USING (survey_id) GROUP BY survey_id""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    """Flight records in feet with a recording flag, read back."""
    lines = one(spark, d).select(F.col("survey_id").alias("file"), F.col("frame_id").alias("line_no"), F.format_string("%.0f,%.7f,%.7f,%.3f,%d", F.round(F.col("t") * 1000), "lat", "lon", F.round("rel", 3), (F.col("frame_id") % 7 == 3).cast("int")).alias("value"))
    back = logs.flight_record_csv(with_header(lines, "time(millisecond),latitude,longitude,height_above_takeoff(feet),isVideo"))
    return back.groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum("t_s"), 3).alias("seconds"), F.round(F.sum("height_m"), 3).alias("height"))
