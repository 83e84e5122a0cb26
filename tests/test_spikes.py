import numpy as np
import pandas as pd

from terravane.operators.spikes import CLIMB, DEGREES, METRES, Settings, implausible, implausible_waypoints, rolling_median, spikes

SCHEMA = "survey_id string, frame_id bigint, time_s double, latitude double, longitude double, relative_altitude_m double, absolute_altitude_m double, source string, t double, __block int"


def flight(n=200, survey="A", seed=0):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.4, 0.6, n))
    lat = 45 + np.cumsum(rng.normal(3e-5, 3e-6, n))
    lon = 29 + np.cumsum(rng.normal(4e-5, 3e-6, n))
    rel = 50 + np.cumsum(rng.normal(0, 0.2, n))
    return pd.DataFrame({"survey_id": survey, "frame_id": np.arange(n), "time_s": t, "latitude": lat, "longitude": lon, "relative_altitude_m": rel, "absolute_altitude_m": rel + 100 + rng.normal(0, 0.1, n), "source": "x", "t": -1.0, "__block": 3})


def found(spark, frame):
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), SCHEMA)
    return {(r.survey_id, r.frame_id, r.field_name) for r in implausible_waypoints(df).collect()}


def test_clean_flight_has_no_cases(spark):
    assert found(spark, flight()) == set()


def test_spike_stuck_and_impossible(spark):
    f = flight()
    f.loc[50, "latitude"] += 0.003
    f.loc[80:82, "longitude"] = 0.0
    f.loc[100, "absolute_altitude_m"] = -9999.0
    f.loc[120:128, "latitude"] = f.loc[120, "latitude"]
    expected = {("A", 50, "latitude"), ("A", 100, "absolute_altitude_m")}
    expected |= {("A", i, "longitude") for i in (80, 81, 82)} | {("A", i, "latitude") for i in range(121, 129)}
    assert found(spark, pd.concat([f, f.iloc[40:130]])) == expected  # repeated rows count once


def test_hover_and_lasting_shift_are_none(spark):
    f = flight()
    f.loc[60:75, ["latitude", "longitude", "relative_altitude_m"]] = f.loc[60, ["latitude", "longitude", "relative_altitude_m"]].values
    f.loc[120:, "time_s"] += 60
    f.loc[120:, "latitude"] += 0.002
    f["absolute_altitude_m"] = np.nan
    assert found(spark, f) == set()


def test_nulls_and_empty_table(spark):
    f = flight(40)
    f.loc[5:9, "latitude"] = np.nan
    f.loc[20, "time_s"] = np.nan
    f.loc[21, "survey_id"] = None
    assert found(spark, f) == set()
    assert found(spark, f.iloc[:0]) == set()
    f["latitude"] = np.nan
    assert found(spark, f) == set()


def test_blocks_do_not_change_the_result(spark):
    f = flight(600)
    f.loc[[100, 299, 300, 301, 450], "longitude"] -= 0.004
    df = spark.createDataFrame(f, SCHEMA)
    args = (df, "survey_id", "frame_id", "time_s", {"latitude": DEGREES, "longitude": DEGREES, "absolute_altitude_m": METRES}, {"relative_altitude_m": CLIMB})
    whole, cut = (sorted(map(tuple, implausible(*args, readings=n, bin_s=b).collect())) for n, b in ((10**6, 1e6), (64, 5.0)))
    assert whole == cut and len(whole) == 5


def test_rolling_median_against_plain():
    x = np.random.default_rng(1).normal(size=50)
    assert np.allclose(rolling_median(x, 3)[3:-3], [np.median(x[i - 3 : i + 4]) for i in range(3, 47)])
    assert len(rolling_median(x[:2], 7)) == 2 and len(rolling_median(x[:0], 7)) == 0
    assert not spikes(np.arange(3.0), np.ones(3), METRES, Settings()).any()


def test_cut_and_uncut_agree_at_any_sampling(spark):
    """Sources sampled every 0.1 s, 10 s and 15 min lose nothing at block edges, with repeated rows and nulls."""
    frames = []
    for n, step in enumerate((0.1, 10.0, 900.0)):
        f = flight(900, f"S{n}", n)
        f["time_s"] = np.arange(900) * step
        f.loc[np.arange(25, 900, 30), "absolute_altitude_m"] += 60
        f.loc[np.arange(300, 420), "absolute_altitude_m"] = np.nan
        frames += [f, f.iloc[100:700], f.iloc[100:700]]
    df = spark.createDataFrame(pd.concat(frames).astype(object).where(pd.concat(frames).notna(), None), SCHEMA)
    args = (df, "survey_id", "frame_id", "time_s", {"latitude": DEGREES, "longitude": DEGREES, "absolute_altitude_m": METRES}, {"relative_altitude_m": CLIMB})
    whole, default, cut = (sorted(map(tuple, implausible(*args, **x).collect())) for x in ({"readings": 10**6, "bin_s": 1e7}, {}, {"readings": 50, "bin_s": 30.0}))
    assert whole == cut == default and len(whole) == 3 * 26
