"""Adapter views: the star-schema tables as point clouds, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import read

POINTS_SQL = """pts AS (SELECT l_orderkey AS okey, l_linenumber AS lno, l_partkey AS pkey, l_suppkey AS skey,
    CASE l_linestatus WHEN 'F' THEN 'day1' ELSE 'day2' END AS survey_id, l_extendedprice / 1050 AS x,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) / 25 AS z,
    0.06 * (l_extendedprice / 1050) + 0.03 * (CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) / 25)
      + CASE l_returnflag WHEN 'R' THEN l_quantity / 5 ELSE l_discount END AS y,
    CAST(floor(l_quantity * 5) AS INT) AS r, CAST(floor(l_discount * 2000) AS INT) AS g, CAST(floor(l_tax * 3000) AS INT) AS b FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of two surveys: x, z in 0..100, y = sloping ground plus objects for one return flag."""
    days = F.date_diff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double")
    x, z = F.col("l_extendedprice") / 1050, days / 25
    rise = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") / 5).otherwise(F.col("l_discount"))
    colour = lambda c, k: F.floor(F.col(c) * k).cast("int")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("lno"), F.col("l_partkey").alias("pkey"), F.col("l_suppkey").alias("skey"),
        F.when(F.col("l_linestatus") == "F", "day1").otherwise("day2").alias("survey_id"), x.alias("x"), z.alias("z"),
        (F.lit(0.06) * x + F.lit(0.03) * z + rise).alias("y"), colour("l_quantity", 5).alias("r"), colour("l_discount", 2000).alias("g"), colour("l_tax", 3000).alias("b"),
    )


def cells_sql(res: float) -> str:
    """CTEs pts and cells."""
    rank = lambda q: f"max(CASE WHEN rk = floor({q} * (n - 1)) THEN y END)"
    return f"""{POINTS_SQL}, rk AS (SELECT survey_id, i, j, y, r, g, b, row_number() OVER (PARTITION BY survey_id, i, j ORDER BY y, r, g, b) - 1 AS rk, count(*) OVER (PARTITION BY survey_id, i, j) AS n
      FROM (SELECT *, CAST(floor(z / {res}) AS BIGINT) AS i, CAST(floor(x / {res}) AS BIGINT) AS j FROM pts)),
    cells AS (SELECT survey_id, i, j, count(*) AS n, {rank('0.1')} AS zlo, {rank('0.5')} AS zmed, {rank('0.95')} AS zhi, max(y) AS zmax,
      avg(CASE WHEN rk >= n // 2 THEN r END) AS r, avg(CASE WHEN rk >= n // 2 THEN g END) AS g, avg(CASE WHEN rk >= n // 2 THEN b END) AS b FROM rk GROUP BY survey_id, i, j)"""


def dense_sql(res: float) -> str:
    """CTEs pts, cells and grid: all cells of the bounding boxes."""
    return f"""{cells_sql(res)}, box AS (SELECT survey_id, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM cells GROUP BY survey_id),
    full_ AS (SELECT survey_id, i, CAST(unnest(range(j0, j1 + 1)) AS BIGINT) AS j FROM (SELECT *, CAST(unnest(range(i0, i1 + 1)) AS BIGINT) AS i FROM box)),
    grid AS (SELECT full_.survey_id, full_.i, full_.j, n, zlo, zmed, zhi, zmax, r, g, b FROM full_ LEFT JOIN cells ON full_.survey_id = cells.survey_id AND full_.i = cells.i AND full_.j = cells.j)"""


def square_sql(agg: str, r: int, where: str = "") -> str:
    """A correlated aggregate over the square of cells around c."""
    return f"(SELECT {agg} FROM grid o WHERE o.survey_id = c.survey_id AND o.i BETWEEN c.i - {r} AND c.i + {r} AND o.j BETWEEN c.j - {r} AND c.j + {r} {where})"
