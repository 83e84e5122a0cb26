import numpy as np
import pandas as pd
import pytest

from terravane.llm import queries
from terravane.llm.nearest_time import nearest_in_time
from terravane.llm.runs import best_starts, collapse_runs, segment

L = "e string, k bigint, t double, tick string, rt int"
R = "e string, r bigint, t double, tick string, gap int"


def pairs(spark, left, right, **more):
    l = spark.createDataFrame([(*x, "x", 0) for x in left], L)  # noqa: E741
    r = spark.createDataFrame([(*x, "x", 0) for x in right], R).withColumnRenamed("t", "u")
    return {(x.e, x.k): x.r for x in nearest_in_time(l, r, "e", "k", "t", "r", "u", 0.4, **more).collect()}


def test_nearest_edges(spark):
    left = [("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, None), (None, 4, 1.0), ("b", 5, 1.0), ("a", 6, 2.0)]
    right = [("a", 10, 0.7), ("a", 10, 0.7), ("a", 11, 1.2), ("a", 12, 5.41), ("a", 13, None), ("c", 14, 1.0), ("a", 15, 1.75), ("a", 16, 2.25)]
    assert pairs(spark, left, right) == {("a", 1): 11, ("a", 6): 15}
    assert pairs(spark, left, []) == {} and pairs(spark, [], right) == {}


@pytest.mark.parametrize("tick", [0.05, 0.4, 3.0, None])
def test_nearest_against_brute_force(spark, tick):
    rng = np.random.default_rng(0)
    left = [("ab"[k % 2], k, float(t)) for k, t in enumerate(rng.uniform(-5, 20, 120))]
    right = [("ab"[k % 2], k, float(t)) for k, t in enumerate(rng.uniform(-5, 20, 90))]
    plain = {}
    for e, k, t in left:
        near = min(((abs(u - t), u, r) for f, r, u in right if f == e and abs(u - t) <= 0.4), default=None)
        if near:
            plain[e, k] = near[2]
    assert pairs(spark, left, right, tick=tick) == plain


def segmentation(distance, penalty):
    """Unpruned dynamic programme over all starts."""
    n = len(distance)
    best, cut = [-penalty], [0]
    total = np.concatenate([[0], np.cumsum(distance)])
    for t in range(1, n + 1):
        costs = [best[s] + (total[t] - total[s + 1]) + penalty for s in range(t)]
        cut.append(int(np.argmin(costs)))
        best.append(min(costs))
    out, t = np.zeros(n, dtype=bool), n
    while t:
        out[cut[t]] = True
        t = cut[t]
    return out


def test_pruned_programme_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        d = rng.choice([0, 0.3, 0.9, 1.4, 5.0], 25) + rng.uniform(0, 0.05, 25)
        fresh = np.zeros(25, dtype=bool)
        fresh[0] = True
        assert best_starts(d, fresh, np.zeros((25, 1)), 1.0).tolist() == segmentation(np.where(fresh, 0, d), 1.0).tolist()


def cheapest(distance, points, penalty, weight):
    """Cost of the best of all segmentations, one by one."""
    n, best = len(distance), np.inf
    for cuts in range(2 ** (n - 1)):
        begin = [0] + [i for i in range(1, n) if cuts >> (i - 1) & 1]
        best = min(best, cost_of(begin, distance, points, penalty, weight))
    return best


def cost_of(begin, distance, points, penalty, weight):
    cost = 0.0
    for a, b in zip(begin, [*begin[1:], len(distance)]):
        cost += penalty + distance[a + 1 : b].sum() + weight * ((points[a:b] - points[a:b].mean(axis=0)) ** 2).sum()
    return cost


@pytest.mark.parametrize("weight", [0.0, 0.05, 0.5, 4.0])
def test_segments_against_all_segmentations(weight):
    rng = np.random.default_rng(3)
    for _ in range(25):
        points = np.cumsum(rng.normal(0, 0.6, (10, 2)), axis=0)
        d = np.append(0.0, np.abs(np.diff(points, axis=0)).max(axis=1))
        begin = segment(d, points, 1.0, weight)
        assert begin[0] == 0 and np.isclose(cost_of(begin, d, points, 1.0, weight), cheapest(d, points, 1.0, weight))


def test_level_term_differs_from_a_threshold(spark):
    """A slow drift: no neighbours are further apart than the tolerance, yet one level cannot stand for all."""
    rows = [("a", i, float(i), 0.2 * i) for i in range(30)] + [("a", 30 + i, 30.0 + i, 50.0) for i in range(5)]
    df = spark.createDataFrame(rows, "e string, i bigint, t double, v double")
    plain = [tuple(r) for r in collapse_runs(df, "e", "t", "i", {"v": 1.0}).orderBy("first_event").collect()]
    assert [r[1:4] for r in plain] == [(0, 29, 30), (30, 34, 5)]
    results = [sorted((r.first_event, r.last_event, r.n_events) for r in collapse_runs(df, "e", "t", "i", {"v": 1.0}, level_weight=0.5, block=b).collect()) for b in (4.0, 1e6)]
    assert results[0] == results[1] and results[0][-1] == (30, 34, 5) and sum(r[2] for r in results[0]) == 35
    assert 2 < len(results[0]) < 20


def test_runs_edges(spark):
    rows = [("a", 1, 0.0, 1.0), ("a", 2, 1.0, 1.05), ("a", 2, 1.0, 1.05), ("a", 3, 2.0, 1.1), ("a", 4, 3.0, 2.0), ("a", 5, 4.0, None), ("a", 6, 5.0, 2.0), ("a", 7, None, 2.0), ("b", 1, 0.0, 1.0), (None, 1, 0.0, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "e string, i bigint, t double, v double, entity string, event int, v0 double")
    for block in (1.5, 1e6):
        got = sorted((r.e, r.first_event, r.last_event, r.n_events, r.duration) for r in collapse_runs(df, "e", "t", "i", {"v": 0.07}, block=block).collect())
        assert got == [("a", 1, 3, 3, 2.0), ("a", 4, 6, 2, 2.0), ("b", 1, 1, 1, 0.0)]
    assert collapse_runs(df.limit(0), "e", "t", "i", {"v": 0.07}).count() == 0


def test_runs_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"e": "a", "i": np.arange(400), "t": np.cumsum(rng.choice([0.5, 0.6, 30.0], 400, p=[0.6, 0.38, 0.02])), "v": np.round(np.cumsum(rng.choice([0, 0, 0, 1], 400)), 3)})
    df = spark.createDataFrame(f.sample(frac=1, random_state=0))
    results = [sorted(map(tuple, collapse_runs(df, "e", "t", "i", {"v": 0.5}, min_events=m, block=b).collect())) for m, b in ((1, 1e9), (1, 5.0), (2, 1e9), (2, 5.0))]
    assert results[0] == results[1] and results[2] == results[3] == [r for r in results[0] if r[3] >= 2]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(name, spark, duck, data, same):
    assert same(queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLE[name]).df())
