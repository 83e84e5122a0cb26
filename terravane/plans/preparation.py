"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravane.operators.regular_grid import regular_series
from terravane.operators.schema_drift import WAYPOINT_LOGS, consistent_readings, migration_steps, unmapped_names
from terravane.operators.spikes import implausible_waypoints
from terravane.operators.wall_clock import instants
from terravane.session import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration_steps(read(spark, sf_dir, "raw_logs")).select("file_id", "field_name", "change")


def p2_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_readings(read(spark, sf_dir, "raw_logs"))


def p2_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmapped_names(read(spark, sf_dir, "raw_logs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_waypoints(read(spark, sf_dir, "waypoints")).select("survey_id", "frame_id", "field_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants(
        read(spark, sf_dir, "clock_marks"),
        read(spark, sf_dir, "rtk_summary"),
        read(spark, sf_dir, "waypoints"),
        mark="mark_id",
        source="survey_id",
        event="frame_id",
        text="wall_text",
        clock="clock",
        offset="clock_offset_s",
        time="time_s",
    )


def _height_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = ["relative_altitude_m", "latitude", "longitude"]
    return regular_series(read(spark, sf_dir, "waypoints"), "survey_id", "time_s", ["relative_altitude_m", "latitude"], needed, "frame_id", step=2.0)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _height_series(spark, sf_dir).where("filled").select("survey_id", "slot_no")


def p6_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _height_series(spark, sf_dir)


QUERIES = {"p2_found": p2_found, "p2_readings": p2_readings, "p2_unmapped": p2_unmapped, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p6_series": p6_series}

_QUOTED = {h: ", ".join(f"'{n}'" for n in WAYPOINT_LOGS.carried(h)) for h in (True, False)}
ORACLE: dict[str, str] = {
    "p2_unmapped": f"""
        WITH l AS (SELECT DISTINCT file_id, line_no = 0 AS header, payload FROM raw_logs WHERE json_valid(payload)),
        k AS (SELECT *, unnest(json_keys(payload)) AS raw_name FROM l)
        SELECT file_id, header, raw_name, count(*) AS n FROM k
        WHERE json_type(payload, '$."' || raw_name || '"') <> 'NULL'
          AND NOT CASE WHEN header THEN raw_name IN ({_QUOTED[True]}) ELSE raw_name IN ({_QUOTED[False]}) END
        GROUP BY ALL""",
    "p6_found": """
        WITH s AS (SELECT DISTINCT survey_id, CAST(floor(time_s / 2) AS BIGINT) AS k FROM waypoints
                   WHERE time_s IS NOT NULL AND relative_altitude_m IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
        g AS (SELECT survey_id, k, lead(k) OVER (PARTITION BY survey_id ORDER BY k) AS nxt FROM s)
        SELECT survey_id, CAST(unnest(range(k + 1, nxt)) AS BIGINT) AS slot_no FROM g WHERE nxt > k + 1""",
}
