"""Camera heights over a table with many cameras at each spot."""

from __future__ import annotations

import duckdb
import pytest

from terravane.operators import grid as G
from terravane.plans import surveys


@pytest.fixture(scope="module")
def folder(tmp_path_factory, data):
    """Four times the points, some without a discount, and 2,000 cameras at 100 spots, some listed two or three times, one without a key."""
    out = tmp_path_factory.mktemp("cameras")
    duckdb.sql(f"COPY (SELECT * REPLACE (l_extendedprice + 37 * k AS l_extendedprice, CASE WHEN l_orderkey % 11 <> k THEN l_discount END AS l_discount) FROM '{data}/lineitem.parquet', (SELECT unnest(range(4)) AS k)) TO '{out}/lineitem.parquet'")
    duckdb.sql(f"COPY (SELECT * REPLACE (k AS s_suppkey) FROM (SELECT * FROM '{data}/supplier.parquet' LIMIT 1), (SELECT unnest(range(2000)) AS k UNION ALL SELECT unnest([3, 4, 4, 120, NULL]) AS k)) TO '{out}/supplier.parquet'")
    return str(out)


@pytest.mark.parametrize("most", [10_000, 0])
def test_points_meet_each_spot_once(spark, same, folder, monkeypatch, most):
    met = []

    def within(left, right, *args, **more):
        met.append(right.count())
        return found(left, right, *args, **more)

    found = G.within
    monkeypatch.setattr(surveys.G, "within", within)
    monkeypatch.setattr(surveys, "BROADCAST_SPOTS", most, raising=False)
    con = duckdb.connect()
    for name in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.sql(surveys.ORACLE["d16_camera_heights"]).df()
    assert len(want) > 3000
    assert same(surveys.QUERIES["d16_camera_heights"](spark, folder).toPandas(), want)
    assert met and max(met) <= 206  # 100 spots of two surveys, and those of the repeated cameras


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantile_of_repeated_values(spark, accuracy):
    import numpy as np

    v = np.random.default_rng(5).normal(0, 1, 400)
    df = spark.createDataFrame([(t, float(x)) for t in (1, 2, 7) for x in v], "t bigint, v double")
    for q in (0.0, 0.15, 0.5, 1.0):
        got = {r.t: r.m for r in G.quantile(df, ["t"], "v", q, "m", accuracy, times="t").collect()}
        assert all(np.isclose(got[t], np.quantile(np.repeat(v, t), q)) for t in (1, 2, 7))
