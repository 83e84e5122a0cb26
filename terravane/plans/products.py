"""Queries over products and comparisons of surveys, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.plans.fixtures import POINTS_SQL, points
from terravane.plans.rasters import PAIR, day_pair
from terravane.plans.telemetry import LOG, log_of
from terravane.session import read, shared_folder
from terravane.sources import products as P

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


_ROWS = ", ".join(f"('{p}', '{g}', '{n}')" for p, g, n in P.PRODUCTS)


@query("b08_export_catalog", f"""WITH {LOG}, s AS (SELECT survey_id, count(lat) > 0 AS has, count(abs_m) > 0 AS high FROM log GROUP BY survey_id), k AS (SELECT survey_id, count(*) > 2 AS posed FROM frame_index WHERE registered GROUP BY survey_id), p(product, kind, needs) AS (VALUES {_ROWS})
    SELECT s.survey_id, product, kind, coalesce(CASE needs WHEN 'points' THEN has WHEN 'mesh' THEN posed ELSE has AND high END, false) AS available FROM s LEFT JOIN k USING (survey_id), p""")
def b08(spark: SparkSession, d: str) -> DataFrame:
    """Exports that each survey allows, judged by its log and its registered frames."""
    s = log_of(spark, d).groupBy("survey_id").agg((F.count("lat") > 0).alias("points"), (F.count("abs_m") > 0).alias("high"))
    k = read(spark, d, "frame_index").where("registered").groupBy("survey_id").agg((F.count("*") > 2).alias("mesh"))
    known = s.join(k, "survey_id", "left").withColumn("georeference", F.col("points") & F.col("high"))
    return P.export_catalog(known)


@query("b14_baseline_snapshot", f"WITH {POINTS_SQL} SELECT survey_id, 'first-day' AS baseline, count(*) AS n, round(max(y), 5) AS top FROM pts WHERE survey_id = 'day1' GROUP BY survey_id")
def b14(spark: SparkSession, d: str) -> DataFrame:
    """One survey's points saved as a baseline, twice, and read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/baselines-{uuid.uuid4().hex}"
    P.save_baseline(points(spark, d), folder, "day2", "second-day")
    P.save_baseline(points(spark, d), folder, "day1", "first-day")
    saved = P.save_baseline(points(spark, d), folder, "day1", "first-day")
    return saved.groupBy("survey_id", "baseline").agg(F.count("*").alias("n"), F.round(F.max("y"), 5).alias("top"))


@query("b15_baseline_deleted", f"WITH {POINTS_SQL} SELECT 'second-day' AS baseline, count(*) AS n FROM pts WHERE survey_id = 'day2'")
def b15(spark: SparkSession, d: str) -> DataFrame:
    """What is left after one of two baselines is deleted."""
    folder = f"{shared_folder(spark).rstrip('/')}/baselines-{uuid.uuid4().hex}"
    P.save_baseline(points(spark, d), folder, "day2", "second-day")
    P.save_baseline(points(spark, d), folder, "day1", "first-day")
    P.delete_baseline(spark, folder, "first-day")
    return spark.read.parquet(folder).groupBy("baseline").agg(F.count("*").alias("n"))


@query("j11_comparison", f"""{PAIR}, c AS (SELECT CASE WHEN gain >= loss THEN 'gain' ELSE 'loss' END AS kind, greatest(gain, loss) AS h FROM p WHERE greatest(gain, loss) > 0.2) SELECT kind, count(*) AS cells, count(*) * 6.25 AS area_m2, round(max(h), 5) AS largest_m, round(sum(h) * 6.25, 3) AS volume_m3 FROM c GROUP BY kind""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Summary of a comparison; the least height asked for (5 cm) is held to 0.2 to 10 m."""
    least = min(10.0, max(0.2, 0.05))
    c = day_pair(spark, d).select(F.when(F.col("gain") >= F.col("loss"), "gain").otherwise("loss").alias("kind"), F.greatest("gain", "loss").alias("h")).where(F.col("h") > least)
    return c.groupBy("kind").agg(F.count("*").alias("cells"), (F.count("*") * 6.25).alias("area_m2"), F.round(F.max("h"), 5).alias("largest_m"), F.round(F.sum("h") * 6.25, 3).alias("volume_m3"))
