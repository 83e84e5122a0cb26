"""Queries of this subpackage and their SQL, as ``__spark_entry__`` takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravane.llm.leakage import leaked
from terravane.llm.nearest_time import nearest_in_time
from terravane.llm.runs import collapse_runs
from terravane.llm.spam import score, spam_pages
from terravane.llm.tokenizer import encode_corpus
from terravane.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearest_in_time(
        read(spark, sf_dir, "frame_index"), read(spark, sf_dir, "waypoints"), "survey_id", "keyframe_no", "timestamp_sec", "frame_id", "time_s", tolerance=0.4
    )
    return pairs.select("survey_id", "keyframe_no", "frame_id")


HOVER = {"latitude": 0.00000125, "longitude": 0.00000125, "relative_altitude_m": 0.0625}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = collapse_runs(read(spark, sf_dir, "waypoints"), "survey_id", "time_s", "frame_id", HOVER, min_events=2)
    return runs.selectExpr("survey_id", "first_event AS first_frame_id", "last_event AS last_frame_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read(spark, sf_dir, "documents"), "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"), "doc_id", "item_id", style="nb_style")
    return found.select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(read(spark, sf_dir, "documents"), "doc_id", style="nb_style")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score(read(spark, sf_dir, "documents"), "doc_id", style="nb_style")
    return scores.selectExpr("doc_id", "abnormal", "round(share, 6) AS share", "round(bits, 4) AS bits")


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_scores": p9_scores}

ORACLE = {
    "p1_found": """
        WITH l AS (SELECT DISTINCT survey_id, keyframe_no, timestamp_sec t FROM frame_index WHERE timestamp_sec IS NOT NULL),
        r AS (SELECT DISTINCT survey_id, frame_id, time_s FROM waypoints WHERE time_s IS NOT NULL),
        b AS (SELECT l.*, CAST(floor(t) AS BIGINT) k FROM l),
        c AS (SELECT r.*, CAST(floor(time_s) AS BIGINT) + d.d AS k FROM r, (SELECT unnest([-1, 0, 1]) d) d)
        SELECT survey_id, keyframe_no, arg_min(frame_id, abs(time_s - t)) AS frame_id
        FROM b JOIN c USING (survey_id, k) WHERE abs(time_s - t) <= 0.4 GROUP BY survey_id, keyframe_no""",
    "p5_found": """
        WITH w AS (SELECT DISTINCT survey_id, frame_id, time_s, latitude a, longitude o, relative_altitude_m h FROM waypoints
                   WHERE time_s IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND relative_altitude_m IS NOT NULL),
        d AS (SELECT *, CASE WHEN abs(a - lag(a) OVER q) <= 0.00000125 AND abs(o - lag(o) OVER q) <= 0.00000125
                              AND abs(h - lag(h) OVER q) <= 0.0625 THEN 0 ELSE 1 END AS f
              FROM w WINDOW q AS (PARTITION BY survey_id ORDER BY time_s, frame_id)),
        g AS (SELECT *, sum(f) OVER (PARTITION BY survey_id ORDER BY time_s, frame_id) AS run FROM d)
        SELECT survey_id, arg_min(frame_id, (time_s, frame_id)) AS first_frame_id, arg_max(frame_id, (time_s, frame_id)) AS last_frame_id
        FROM g GROUP BY survey_id, run HAVING count(*) >= 2""",
}
