"""Kernels and blockwise functions against plain versions, with random input."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.functions import geodesy as D
from terravane.operators import fitting, grid, kernels, neighbour
from terravane.operators.sequences import with_context


def flood(mask):
    out, n = np.zeros(mask.shape, dtype=int), 0
    for seed in map(tuple, np.argwhere(mask)):
        if out[seed]:
            continue
        n += 1
        stack = [seed]
        out[seed] = n
        while stack:
            i, j = stack.pop()
            for k in range(max(0, i - 1), min(mask.shape[0], i + 2)):
                for m in range(max(0, j - 1), min(mask.shape[1], j + 2)):
                    if mask[k, m] and not out[k, m]:
                        out[k, m] = n
                        stack.append((k, m))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 14), st.integers(1, 14), st.floats(0.1, 0.9))
def test_labels_and_distance(seed, rows, cols, share):
    mask = np.random.default_rng(seed).random((rows, cols)) < share
    a, b = kernels.label(mask), flood(mask)
    assert (a > 0).tolist() == mask.tolist()
    assert len({(x, y) for x, y in zip(a[mask], b[mask])}) == len(set(a[mask])) == len(set(b[mask]))
    d = kernels.distance(mask)
    on = np.argwhere(mask)
    for i in range(rows):
        for j in range(cols):
            plain = math.inf if not len(on) else math.sqrt(((on - [i, j]) ** 2).sum(1).min())
            assert d[i, j] == pytest.approx(plain)


def test_thinning_keeps_components():
    mask = np.zeros((20, 30), dtype=bool)
    mask[3:8, 2:25], mask[12:16, 5:9] = True, True
    thin = kernels.thin(mask)
    assert (thin & ~mask).sum() == 0 and thin.sum() < mask.sum() / 3
    assert kernels.label(thin).max() == 2
    ways = kernels.longest_ways(thin)
    assert len(ways[0]) >= 15


def test_ways_and_lines():
    free = np.ones((6, 6), dtype=bool)
    free[1:5, 3] = False
    cost, way = kernels.cheapest_way(lambda a, b, c, d: math.hypot(c - a, d - b), free, (3, 0), (3, 5))
    assert way[0] == (3, 0) and way[-1] == (3, 5) and all(free[p] for p in way)
    assert cost == pytest.approx(4 * math.sqrt(2) + 2 + math.sqrt(2) * 0, abs=1.5)
    assert kernels.cheapest_way(lambda *a: 1.0, np.eye(3, dtype=bool)[:, ::-1] & False, (0, 0), (2, 2))[0] == math.inf
    line = np.c_[np.arange(11.0), np.where(np.arange(11) == 5, 3.0, 0.0)]
    assert kernels.simplify(line, 0.5).tolist() == [0, 4, 5, 6, 10]


def test_fits():
    rng = np.random.default_rng(0)
    x, z = rng.uniform(0, 10, (2, 300))
    y = 0.3 * x - 0.2 * z + 4 + rng.normal(0, 0.02, 300)
    y[:60] += 5
    fit, sigma = kernels.robust_plane(x, z, y)
    assert np.allclose(fit, [0.3, -0.2, 4], atol=0.02) and sigma < 0.1
    found, near = kernels.consensus_plane(x, z, y, 0.1)
    assert near.sum() == 240 and np.allclose(found, [0.3, -0.2, 4], atol=0.05)
    a = rng.normal(size=(40, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    s, r, t = kernels.similarity(a, 2.5 * a @ turn.T + [1, 2, 3])
    assert s == pytest.approx(2.5) and np.allclose(r, turn) and np.allclose(t, [1, 2, 3])
    box = np.array([[0, 0], [4, 0], [4, 2], [0, 2]]) @ np.array([[0.8, 0.6], [-0.6, 0.8]])
    _, length, width, _ = kernels.smallest_rectangle(box)
    assert (length, width) == (pytest.approx(4), pytest.approx(2))
    base = rng.normal(size=(30, 30))
    assert kernels.shift_between(base, np.roll(base, (2, -3), (0, 1)), 5)[:2] == (2, -3)


def test_components_across_tiles(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((30, 40)) < 0.42
    cells = [("s", int(i), int(j)) for i, j in np.argwhere(mask)]
    got = neighbour.components(spark.createDataFrame(cells, "survey_id string, i bigint, j bigint"), tile=8).toPandas()
    plain = flood(mask)
    pairs = {(int(r.label), int(plain[r.i, r.j])) for r in got.itertuples()}
    assert len(got) == mask.sum() and len(pairs) == plain.max() == got.label.nunique()
    empty = spark.createDataFrame([], "survey_id string, i bigint, j bigint")
    assert neighbour.components(empty).count() == 0


def test_context_is_what_whole_windows_give(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[k % 2], float(t), k, None if rng.random() < 0.3 else float(k)) for k, t in enumerate(np.sort(rng.uniform(0, 100, 60)))]
    df = spark.createDataFrame(rows, "e string, t double, k bigint, v double")
    got = with_context(df, ["e"], ["t", "k"], 7.0, previous={"p": "v"}, following={"f": "v"}, last={"l": "v"}, upcoming={"u": "v"}, running={"r": F.lit(1)}).toPandas().sort_values(["e", "t"])
    pdf = pd.DataFrame(rows, columns=["e", "t", "k", "v"]).sort_values(["e", "t"])
    g = pdf.groupby("e")["v"]
    for name, plain in (("p", g.shift(1)), ("f", g.shift(-1)), ("l", g.ffill()), ("u", g.bfill()), ("r", pdf.groupby("e").cumcount() + 1)):
        assert np.allclose(got[name].to_numpy(float), plain.to_numpy(float), equal_nan=True), name


def test_geodesy(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(o), float(h)) for a, o, h in zip(rng.uniform(-80, 80, 50), rng.uniform(-180, 180, 50), rng.uniform(-400, 9000, 50))]
    df = spark.createDataFrame(rows, "a double, o double, h double")
    a, o, h = F.col("a"), F.col("o"), F.col("h")
    back = D.from_ecef(*D.to_ecef(a, o, h))
    zone = D.utm_zone(a, o)
    utm = D.utm_forward(a, o, zone)
    inverse = D.utm_inverse(*utm, zone, a >= 0)
    out = df.select((back[0] - a).alias("x"), (back[1] - o).alias("y"), (back[2] - h).alias("z"), (inverse[0] - a).alias("u"), (inverse[1] - o).alias("v")).toPandas()
    assert out[["x", "y", "u", "v"]].abs().max().max() < 1e-9 and out["z"].abs().max() < 1e-4
    one = spark.range(1).select(*[F.round(c, 2) for c in D.utm_forward(F.lit(45.31), F.lit(29.29), F.lit(35))]).first()
    plain = D.utm_point(45.31, 29.29, 35)
    assert abs(one[0] - plain[0]) < 0.01 and abs(one[1] - plain[1]) < 0.01
    # along the central meridian the northing is the meridian arc times the scale factor
    steps = np.radians(np.linspace(0, 45, 200_001))
    arc = np.trapezoid(D.A * (1 - D.E2) / (1 - D.E2 * np.sin(steps) ** 2) ** 1.5, steps)
    assert abs(D.utm_point(45.0, 27.0, 35)[1] - D.K0 * arc) < 1e-3 and D.utm_point(45.0, 27.0, 35)[0] == 500000.0


def test_moment_fit(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(100, 2)) * 20
    c, s = math.cos(0.4), math.sin(0.4)
    q = 1.7 * p @ np.array([[c, s], [-s, c]]) + [3, -8]
    q[:5] += 80
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[p, q]], "x double, y double, u double, v double")
    (scale, rotation, shift), n = fitting.trimmed_fit(df, ["x", "y"], ["u", "v"])
    assert n == 95 and scale == pytest.approx(1.7) and np.allclose(shift, [3, -8]) and np.allclose(rotation, [[c, -s], [s, c]])


def test_floor_rank_quantile(spark):
    df = spark.createDataFrame([("s", float(k)) for k in (1, 2, 3, 4)], "survey_id string, y double")
    got = grid.ranked(df, ["survey_id"], "y").agg(grid.at_rank("y", 0.9).alias("q")).first()["q"]
    assert got == 3.0


def test_ground_mode_finds_planted_ground(spark):
    from terravane.operators.fitting import ground_mode

    rng = np.random.default_rng(4)
    for level, share in ((12.0, 0.6), (-3.0, 0.9), (250.0, 0.45)):
        n = 4000
        ground = rng.normal(level, 0.05, int(n * share))
        above = level + rng.uniform(2, 25, n - len(ground))
        heights = np.concatenate([ground, above, [level - 4000.0, level + 9e5, np.nan]])
        df = spark.createDataFrame([(float(h),) for h in heights] + [(None,)], "h double")
        assert abs(ground_mode(df, "h") - level) < 0.05
    assert ground_mode(df.limit(0), "h") is None and ground_mode(spark.createDataFrame([(5.0,)] * 3, "h double"), "h") == 5.0


def test_planes_of_large_objects_and_degenerate_points():
    rng = np.random.default_rng(6)
    x, z = rng.uniform(0, 100, (2, 200_000))
    y = 0.1 * x + 3 + rng.normal(0, 0.01, len(x))
    y[: len(x) // 2] = rng.uniform(0, 50, len(x) // 2)
    fit, near = kernels.consensus_plane(x, z, y, 0.05)
    assert np.allclose(fit, [0.1, 0, 3], atol=0.01) and near[len(x) // 2 :].mean() > 0.99
    assert kernels.consensus_plane(np.arange(5.0), np.arange(5.0), np.arange(5.0), 0.1) is None
    assert kernels.consensus_plane(x[:2], z[:2], y[:2], 0.1) is None
    fit, sigma = kernels.robust_plane(x[:3], z[:3], 2 * x[:3])
    assert np.allclose(fit, [2, 0, 0], atol=1e-6) and sigma < 1e-6


def test_labels_by_edges():
    grid = np.eye(4, dtype=bool)
    assert kernels.label(grid).max() == 1 and kernels.label(grid, corners=False).max() == 4


def test_quantiles_of_any_group_size(spark):
    from terravane.operators.grid import numbered, quantiles

    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=3000), "b": np.round(rng.normal(size=700), 1), "c": np.array([5.0]), "d": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("e", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for accuracy in (100, 10_000):
        from terravane.operators.grid import quantile

        for q in (0.0, 0.1, 0.5, 0.905, 1.0):
            got = {r.g: r.x for r in quantile(df, ["g"], "v", q, "x", accuracy).collect()}
            assert got.keys() == groups.keys() and all(got[g] == pytest.approx(np.quantile(x, q)) for g, x in groups.items())
    assert {r.g: r.lo for r in quantiles(df, ["g"], lo=("v", 0.25)).collect()}["e"] is None
    ordered = numbered(df.where("v IS NOT NULL"), [df["v"], df["g"]], "no").orderBy("no").collect()
    assert [r.no for r in ordered] == list(range(1, len(ordered) + 1)) and all(a.v <= b.v for a, b in zip(ordered, ordered[1:]))
    assert numbered(df.limit(0), [df["v"]], "no").count() == 0


def test_nearest_cells_links_and_crowds_against_brute_force(spark):
    from terravane.operators import grid, neighbour

    rng = np.random.default_rng(9)
    cells = [("s", int(i), int(j)) for i in range(-3, 25) for j in range(30) if rng.random() < 0.7]
    mask = [("s", int(i), int(j)) for i, j in zip(rng.integers(-10, 40, 9), rng.integers(-5, 45, 9))]
    make = lambda x: spark.createDataFrame(x, "survey_id string, i bigint, j bigint")
    got = {(r.i, r.j): (r.d2, r.near_i, r.near_j) for r in neighbour.nearest_cells(make(cells), make(mask)).collect()}
    assert got == {(i, j): min(((i - a) ** 2 + (j - b) ** 2, a, b) for _, a, b in mask) for _, i, j in cells}
    assert neighbour.nearest_cells(make(cells), make(mask).limit(0)).count() == 0
    p = rng.uniform(0, 30, (150, 2))
    points = spark.createDataFrame([("s", k, float(x), float(z)) for k, (x, z) in enumerate(p)], "survey_id string, pid bigint, x double, z double")
    away = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    for d in (1.0, 2.5):
        label = np.arange(150)
        for _ in range(150):
            label = np.array([label[away[k] <= d].min() for k in range(150)])
        got = {r.pid: r.label for r in grid.linked(points, d).collect()}
        assert [got[k] for k in range(150)] == label.tolist()
        assert grid.crowded(points, d, 3).count() == ((away <= d).sum(axis=1) >= 3).sum()


def test_holes_that_touch_corners_are_filled(spark):
    from terravane.operators.neighbour import fill_holes

    grid = np.ones((7, 7), dtype=bool)
    grid[2, 2] = grid[3, 3] = False  # corners only
    grid[5, 5] = grid[6, 5] = False  # reaches the border
    make = lambda x: spark.createDataFrame([("s", int(i), int(j)) for i, j in np.argwhere(x)], "survey_id string, i bigint, j bigint")
    got = {(r.i, r.j) for r in fill_holes(make(grid), make(np.ones((7, 7), dtype=bool))).collect()}
    assert got == {(i, j) for i in range(7) for j in range(7)} - {(5, 5), (6, 5)}
