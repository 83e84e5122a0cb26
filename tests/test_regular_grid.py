import numpy as np

from terravane.operators.regular_grid import SLOTS, fill_linear, regular_series, ssa_impute

SCHEMA = "survey_id string, frame_id bigint, time_s double, h double, lat double, slot string, v0 int"
ARGS = ("survey_id", "time_s", ["h", "lat"], ["h", "lat"], "frame_id")


def test_slots_marks_and_values(spark):
    rows = [("A", 1, 0.1, 1.0, 5.0), ("A", 2, 1.9, 3.0, 5.0), ("A", 2, 1.9, 3.0, 5.0), ("A", 3, 6.0, 9.0, 5.0), ("A", 4, 3.0, None, 5.0), ("A", 5, None, 1.0, 5.0), ("B", 1, 7.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    got = {(r.survey_id, r.slot_no): r for r in regular_series(df, *ARGS, step=2.0).collect()}
    assert sorted(got) == [("A", 0), ("A", 1), ("A", 2), ("A", 3), ("B", 3)]
    assert got["A", 0].n_readings == 2 and got["A", 0].h == 2.0 and not got["A", 0].filled
    assert got["A", 1].filled and got["A", 1].h is not None and got["A", 1].how == "linear"  # four slots are too few to decompose
    assert regular_series(df.limit(0), *ARGS, step=2.0).count() == 0


def test_gaps_across_and_beyond_blocks(spark):
    step = 2.0
    slots = [0, 5, SLOTS - 2, SLOTS + 3, 4 * SLOTS + 10, 4 * SLOTS + 11]
    df = spark.createDataFrame([("A", i, s * step + 0.5, float(s), 1.0, "x", 0) for i, s in enumerate(slots)], SCHEMA)
    rows = sorted(regular_series(df, *ARGS, step=step).collect(), key=lambda r: r.slot_no)
    assert [r.slot_no for r in rows] == list(range(slots[-1] + 1))
    assert [r.slot_no for r in rows if not r.filled] == slots
    assert {r.how for r in rows} == {"read", "ssa", "linear"}
    linear = [r.slot_no for r in rows if r.how == "linear"]  # blocks that see no reading
    assert min(linear) == 2 * SLOTS and max(linear) == 3 * SLOTS - 1
    assert all(abs(r.h - r.slot_no) < 1e-6 for r in rows if r.how == "linear")


def test_gaps_are_filled_from_both_sides(spark):
    """A wave with gaps at and across block edges comes out as in one array over the whole series."""
    n = 2 * SLOTS + 300
    t = np.arange(n)
    x = 5 * np.sin(t / 6) + 0.01 * t
    missing = np.zeros(n, dtype=bool)
    for a, b in ((SLOTS - 6, SLOTS + 6), (2 * SLOTS, 2 * SLOTS + 12), (400, 412)):
        missing[a:b] = True
    df = spark.createDataFrame([("A", int(i), 2.0 * float(i) + 0.5, float(x[i]), 1.0, "x", 0) for i in np.flatnonzero(~missing)], SCHEMA)
    rows = sorted(regular_series(df, *ARGS, step=2.0).collect(), key=lambda r: r.slot_no)
    got = np.array([r.h for r in rows])
    assert [r.how for r in rows] == np.where(missing, "ssa", "read").tolist()
    assert np.abs(got - x)[missing].mean() < 0.3 * np.abs(fill_linear(x, missing) - x)[missing].mean()


def test_imputation_beats_the_line():
    t = np.arange(400)
    x = 5 * np.sin(t / 6) + 0.02 * t
    missing = np.zeros(400, dtype=bool)
    for a in (50, 130, 220, 300):
        missing[a : a + 12] = True
    y = np.where(missing, 0, x)
    error = lambda z: np.sqrt(np.mean((z - x)[missing] ** 2))
    assert error(ssa_impute(y, missing)) < 0.3 * error(fill_linear(y, missing))
    assert np.allclose(ssa_impute(np.ones(5), np.array([0, 1, 0, 0, 0], dtype=bool)), 1)


def test_imputation_runs_until_it_converges():
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=600)) + 8 * np.sin(np.arange(600) / 9)
    missing = np.zeros(600, dtype=bool)
    for a, b in ((60, 150), (260, 300), (420, 560)):
        missing[a:b] = True
    x[missing] = 0
    y = fill_linear(x, missing)
    centre, spread = y.mean(), y.std()
    y, rounds, change = (y - centre) / spread, 0, 1.0
    at = np.arange(577)[:, None] + np.arange(24)
    while change >= 1e-3:
        u, s, v = np.linalg.svd(y[at], full_matrices=False)
        low = (u[:, :4] * s[:4]) @ v[:4]
        new = np.bincount(at.ravel(), weights=low.ravel()) / np.bincount(at.ravel())
        change, rounds = np.abs(new - y)[missing].max(), rounds + 1
        y[missing] = new[missing]
    assert rounds > 60
    assert np.allclose(ssa_impute(x, missing)[missing], (y * spread + centre)[missing], atol=1e-6)
