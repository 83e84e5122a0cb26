"""The dynamic programme of runs makes their boundaries."""

from __future__ import annotations

import numpy as np

from terravane.llm import runs
from terravane.llm.runs import best_starts, collapse_runs, segment


def test_programme_finds_all_boundaries(monkeypatch):
    """No boundary of the additive costs is set beside the programme, and long sequences lose no digits."""
    n = 20_000
    d = np.full(n, 1.0)
    d[[0, 7000, 15000]] = 0.0, 1 + 1e-13, 1 + 1e-13
    fresh = np.arange(n) == 0
    points = np.zeros((n, 1))
    assert segment(d, points, 1.0, 0.0) == [0, 7000, 15000]
    assert np.flatnonzero(best_starts(d, fresh, points, 1.0)).tolist() == [0, 7000, 15000]
    monkeypatch.setattr(runs, "segment", lambda distance, *_: [0])
    assert np.flatnonzero(best_starts(d, fresh, points, 1.0)).tolist() == [0]


def test_infinite_values_are_no_neighbours(spark):
    inf = float("inf")
    rows = [("a", i, float(i), v) for i, v in enumerate([1.0, 1.0, inf, inf, 2.0, 2.0, -inf, -inf, 3.0, 3.0])]
    df = spark.createDataFrame(rows, "e string, i bigint, t double, v double")
    for block in (2.5, 3.0, 1e6):
        got = sorted((r.first_event, r.last_event) for r in collapse_runs(df, "e", "t", "i", {"v": 0.5}, min_events=2, block=block).collect())
        assert got == [(0, 1), (4, 5), (8, 9)]
