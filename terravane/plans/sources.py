"""Queries over readers, writers and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.plans.fixtures import POINTS_SQL, points
from terravane.plans.telemetry import LOG, log_of
from terravane.session import read
from terravane.sources import sinks
from terravane.sources.formats import receiver_log, subtitle_log
from terravane.streaming import selector, windows

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


@query("a07_subtitle_parse", f"""WITH {LOG} SELECT survey_id, count(*) AS n, round(sum(round(t, 3)), 3) AS seconds, round(sum(round(rel, 1)), 1) AS height, count(rel) AS n_height FROM log WHERE lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) < 1000 AND abs(lon) < 1000 GROUP BY survey_id""")
def a07(spark: SparkSession, d: str) -> DataFrame:
    """Subtitle files rendered from the logs, ten minutes each, and parsed back."""
    rows = log_of(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) < 1000 AND abs(lon) < 1000")
    ms = F.round(F.col("t") * 1000).cast("bigint")
    two = lambda by, of: F.lpad((F.floor(ms / by) % of).cast("string"), 2, "0")
    stamp = F.concat(F.lpad(F.floor(ms / 3600000).cast("string"), 2, "0"), F.lit(":"), two(60000, 60), F.lit(":"), two(1000, 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    height = F.when(F.col("rel").isNotNull(), F.concat(F.lit("[rel_alt: "), F.format_string("%.1f", F.round("rel", 1)), F.lit("]"))).otherwise(F.lit(""))
    cue = F.concat(F.lit("1\n"), stamp, F.lit(" --> 99:00:00,000\n"), F.format_string("<font>[latitude: %.7f] [longitude: %.7f] ", "lat", "lon"), height, F.lit("</font>"))
    files = rows.groupBy("survey_id", F.floor(F.col("t") / 600).alias("part")).agg(F.array_join(F.collect_list(cue), "\n\n").alias("value"))
    texts = files.select(F.concat_ws("#", "survey_id", "part").alias("file"), "value")
    parsed = subtitle_log(texts).withColumn("survey_id", F.split("file", "#")[0])
    return parsed.groupBy("survey_id").agg(F.count("*").alias("n"), F.round(F.sum("time_s"), 3).alias("seconds"), F.round(F.sum("altitude_m"), 1).alias("height"), F.count("altitude_m").alias("n_height"))


@query("a13_receiver_log", f"""WITH {LOG} SELECT survey_id AS file, count(*) AS n, round(min(315964800 + 2300 * 604800.0 + round(t, 3)), 3) AS t0, round(avg(round(lat, 7)), 5) AS lat FROM log WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND abs_m IS NOT NULL AND rtk_q IS NOT NULL GROUP BY survey_id""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Receiver solution lines rendered from the logs and parsed back."""
    rows = log_of(spark, d).where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND abs_m IS NOT NULL AND rtk_q IS NOT NULL")
    lines = rows.select(F.col("survey_id").alias("file"), F.format_string("2300  %.3f  %.7f  %.7f %.3f  %d 9", "t", "lat", "lon", "abs_m", "rtk_q").alias("value"))
    return receiver_log(lines).groupBy("file").agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("t0"), F.round(F.avg("lat"), 5).alias("lat"))


@query("a14_clock_coverage", "WITH m AS (SELECT DISTINCT mark_id, survey_id, wall_text FROM clock_marks) SELECT survey_id, count(*) AS n, round(avg(CASE WHEN regexp_matches(wall_text, '\\d{2}:\\d{2}:\\d{2}') THEN 1 ELSE 0 END), 6) AS share, avg(CASE WHEN regexp_matches(wall_text, '\\d{2}:\\d{2}:\\d{2}') THEN 1 ELSE 0 END) >= 0.8 AS usable FROM m GROUP BY survey_id")
def a14(spark: SparkSession, d: str) -> DataFrame:
    marks = read(spark, d, "clock_marks").select("mark_id", "survey_id", "wall_text").distinct()
    share = F.avg(F.coalesce(F.col("wall_text").rlike(r"\d{2}:\d{2}:\d{2}"), F.lit(False)).cast("int"))
    return marks.groupBy("survey_id").agg(F.count("*").alias("n"), F.round(share, 6).alias("share"), (share >= 0.8).alias("usable"))


@query("a18_survey_catalog", """WITH f AS (SELECT survey_id, min(site) AS site, min(source) AS source FROM flight_data GROUP BY survey_id), w AS (SELECT survey_id, max(received_at) AS newest, count(*) AS uploads FROM waypoints GROUP BY survey_id)
    SELECT survey_id, site, source, CAST(newest AS VARCHAR)[:19] AS newest, coalesce(uploads, 0) AS uploads FROM f LEFT JOIN w USING (survey_id)""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "flight_data").groupBy("survey_id").agg(F.min("site").alias("site"), F.min("source").alias("source"))
    w = read(spark, d, "waypoints").groupBy("survey_id").agg(F.max("received_at").alias("newest"), F.count("*").alias("uploads"))
    return f.join(w, "survey_id", "left").select("survey_id", "site", "source", F.substring(F.col("newest").cast("string"), 1, 19).alias("newest"), F.coalesce("uploads", F.lit(0)).alias("uploads"))


@query("a20_every_third_frame", "WITH f AS (SELECT DISTINCT survey_id, filename FROM frame_index) SELECT survey_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY CAST(regexp_extract(filename, '(\\d+)\\.', 1) AS BIGINT), filename) AS k FROM f) WHERE (k - 1) % 3 = 0")
def a20(spark: SparkSession, d: str) -> DataFrame:
    """Every third frame in natural order of the file names."""
    from terravane.operators.sequences import with_context

    f = read(spark, d, "frame_index").select("survey_id", "filename").distinct().withColumn("no", F.regexp_extract("filename", r"(\d+)\.", 1).cast("bigint"))
    counted = with_context(f, ["survey_id"], ["no", "filename"], 100_000.0, running={"k": F.lit(1)})
    return counted.where("(k - 1) % 3 = 0").select("survey_id", "filename")


@query("b03_exchange_quantisation", f"""WITH {POINTS_SQL}, m AS (SELECT survey_id, floor(min(x)) AS x0, floor(min(y)) AS y0, floor(min(z)) AS z0 FROM pts GROUP BY survey_id) SELECT survey_id, count(*) AS n, CAST(sum(CAST(round((z - z0) / 0.001) AS BIGINT)) AS BIGINT) AS sz, CAST(sum(CAST(floor((0.299e0 * r + 0.587e0 * g + 0.114e0 * b) * 257) AS BIGINT)) AS BIGINT) AS si FROM pts JOIN m USING (survey_id) GROUP BY survey_id""")
def b03(spark: SparkSession, d: str) -> DataFrame:
    q = sinks.quantised(points(spark, d))
    return q.groupBy("survey_id").agg(F.count("*").alias("n"), F.sum("qz").alias("sz"), F.sum(F.col("intensity").cast("bigint")).alias("si"))


@query("b06_track_features", f"WITH {LOG} SELECT survey_id, CAST(floor(t / 600) AS BIGINT) AS part, count(*) AS n FROM log WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL")
def b06(spark: SparkSession, d: str) -> DataFrame:
    """Line features of ten minutes each, counted through their own JSON."""
    rows = log_of(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("part", F.floor(F.col("t") / 600))
    lines = sinks.geojson_line(rows, ["survey_id", "part"], ["t", "frame_id"], "lon", "lat")
    points_ = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<double>>")
    return lines.select("survey_id", "part", F.size(points_).cast("bigint").alias("n"))


@query("b11_top_view", f"""WITH {POINTS_SQL}, e AS (SELECT survey_id, quantile_cont(x, 0.005) AS a, quantile_cont(x, 0.995) AS b_ FROM pts GROUP BY survey_id) SELECT survey_id, CAST(floor(z / 2) AS BIGINT) AS row, CAST(floor(x / 2) AS BIGINT) AS col, max(row(y, r, g, b))[2] AS r, max(row(y, r, g, b))[3] AS g, max(row(y, r, g, b))[4] AS b FROM pts JOIN e USING (survey_id) WHERE x BETWEEN a AND b_ GROUP BY ALL""")
def b11(spark: SparkSession, d: str) -> DataFrame:
    return sinks.top_view(points(spark, d), cols=50)


@query("b13_json_safe_numbers", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS value FROM supplier")
def b13(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("s_suppkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), sinks.json_safe(odd).alias("value"))


@query("c19_keyframe_selection")
def c19(spark: SparkSession, d: str) -> DataFrame:
    return selector.select_batch(selector.frames_of(read(spark, d, "frame_index")))


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("s01_tumbling_windows", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR)[:19] AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(events(spark, d), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("s02_sliding_windows", "SELECT CAST(date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS VARCHAR)[:19] AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 3)) AS k) GROUP BY ALL")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(events(spark, d), "3 hours", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("s03_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, CAST(date_trunc('second', min(ts)) AS VARCHAR)[:19] AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(events(spark, d), "2 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("s04_streamed_totals", "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def s04(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts from the streaming engine, in complete mode, run to the end of the folder."""
    found = windows.run_to_end(windows.tumbling(windows.event_stream(spark, d), "1 day", "1 hour"), "complete")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("s05_streamed_keyframes")
def s05(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes from the stateful streaming operator, users' events as streams of frames."""
    frames = windows.event_stream(spark, d).select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("frame_no"), (F.unix_millis("ts") / 1000.0).alias("t"), F.col("value").alias("sharpness"), (F.col("event_id") % 97).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("survival"))
    return windows.run_to_end(selector.select_stream(frames))


@query("s06_streamed_once_each", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def s06(spark: SparkSession, d: str) -> DataFrame:
    found = windows.run_to_end(windows.once_each(windows.event_stream(spark, d), "40 days").select("event_id", "event_type"))
    return found.groupBy("event_type").agg(F.count_distinct("event_id").alias("n"))
