"""Small catalog, fallback and change-map queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.plans.geodesy import CHECK, checks
from terravane.plans.rasters import PAIR, REACH, day_pair
from terravane.plans.surveys import linked_sql
from terravane.session import cut_lineage, read

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


@query("a12_fallback_logs", """WITH f AS (SELECT survey_id, min(source) AS source FROM flight_data GROUP BY survey_id), w AS (SELECT survey_id, count(*) AS n FROM waypoints WHERE rtk_q = 1 GROUP BY survey_id) SELECT survey_id, CASE WHEN w.n IS NULL THEN 'SYNTHETIC' ELSE source END AS source, w.n IS NULL AS is_synthetic, coalesce(w.n, 0) AS n FROM f LEFT JOIN w USING (survey_id)""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Surveys without a usable log are marked synthetic and carry no waypoints."""
    f = read(spark, d, "flight_data").groupBy("survey_id").agg(F.min("source").alias("source"))
    w = read(spark, d, "waypoints").where("rtk_q = 1").groupBy("survey_id").agg(F.count("*").alias("n"))
    none = F.col("n").isNull()
    return f.join(w, "survey_id", "left").select("survey_id", F.when(none, "SYNTHETIC").otherwise(F.col("source")).alias("source"), none.alias("is_synthetic"), F.coalesce("n", F.lit(0)).alias("n"))


@query("a21_active_source", """WITH r AS (SELECT DISTINCT survey_id FROM rtk_summary), f AS (SELECT DISTINCT survey_id FROM frame_index), s AS (SELECT DISTINCT survey_id FROM flight_data) SELECT survey_id, CASE WHEN r.survey_id IS NOT NULL THEN 'rtk' WHEN f.survey_id IS NOT NULL THEN 'frames' ELSE 'log' END AS source FROM s LEFT JOIN r USING (survey_id) LEFT JOIN f USING (survey_id)""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    """The best position source that a survey has, by priority."""
    ids = lambda t, n: read(spark, d, t).select("survey_id").distinct().withColumn(n, F.lit(True))
    s = read(spark, d, "flight_data").select("survey_id").distinct()
    return s.join(ids("rtk_summary", "r"), "survey_id", "left").join(ids("frame_index", "f"), "survey_id", "left").select("survey_id", F.when(F.col("r"), "rtk").when(F.col("f"), "frames").otherwise("log").alias("source"))


@query("j10_change_map", f"{PAIR} SELECT i, j, round(least(1.0, greatest(0.0, (greatest(gain, loss) - 0.3) / 0.9)), 5) AS alpha, CASE WHEN gain >= loss THEN 'gain' ELSE 'loss' END AS kind FROM p")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Significance of each cell's change, 0..1."""
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.greatest("gain", "loss") - 0.3) / 0.9))
    return day_pair(spark, d).select("i", "j", F.round(alpha, 5).alias("alpha"), F.when(F.col("gain") >= F.col("loss"), "gain").otherwise("loss").alias("kind"))


@query("j08_change_clusters", f"""{PAIR.replace('WITH ', 'WITH RECURSIVE ', 1)}, mask AS (SELECT CASE WHEN gain > 0.6 THEN 'gain' ELSE 'loss' END AS survey_id, i, j FROM p WHERE gain > 0.6 OR loss > 0.6), {REACH}, alerts AS (SELECT survey_id, CAST(label AS BIGINT) AS pid, (avg(j) + 0.5) * 2.5 AS x, (avg(i) + 0.5) * 2.5 AS z FROM lab GROUP BY survey_id, label HAVING count(*) * 6.25 >= 12), {linked_sql(40.0)}""")
def j08(spark: SparkSession, d: str) -> DataFrame:
    """Changes whose centres are linked within 40 m, in clusters of at least three."""
    from terravane.operators import grid as G
    from terravane.operators.neighbour import components

    kind = F.when(F.col("gain") > 0.6, "gain").otherwise("loss")
    changed = day_pair(spark, d).where("gain > 0.6 OR loss > 0.6").select(kind.alias("survey_id"), "i", "j")
    o = components(changed).groupBy("survey_id", F.col("label").alias("pid")).agg(F.count("*").alias("n"), ((F.avg("j") + 0.5) * 2.5).alias("x"), ((F.avg("i") + 0.5) * 2.5).alias("z")).where(F.col("n") * 6.25 >= 12)
    return G.linked(cut_lineage(o), 40.0).groupBy("survey_id", "label").agg(F.count("*").alias("members")).where("members >= 3")


@query("k04_check_points_edited", f"WITH {CHECK} SELECT survey, id, round(dh, 6) AS dh FROM chk WHERE id % 10 <> 3 UNION ALL SELECT 99 AS survey, 1000 AS id, 0.25 AS dh")
def k04(spark: SparkSession, d: str) -> DataFrame:
    """The check-point table after one point is added and some are deleted by id."""
    kept = checks(spark, d).where("id % 10 <> 3").select("survey", F.col("id").cast("bigint").alias("id"), F.round("dh", 6).alias("dh"))
    return kept.unionByName(spark.createDataFrame([(99, 1000, 0.25)], "survey int, id bigint, dh double"))


@query("l07_detection_summary", "SELECT event_type AS class, CASE WHEN value > 60 THEN 'moving' WHEN value > 30 THEN 'undecided' ELSE 'static' END AS state, count(*) AS n FROM events GROUP BY ALL")
def l07(spark: SparkSession, d: str) -> DataFrame:
    """Detections by class and motion, events standing in for them."""
    state = F.when(F.col("value") > 60, "moving").when(F.col("value") > 30, "undecided").otherwise("static")
    return read(spark, d, "events").groupBy(F.col("event_type").alias("class"), state.alias("state")).agg(F.count("*").alias("n"))
