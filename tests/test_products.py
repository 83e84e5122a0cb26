import struct
import zlib

import numpy as np
import pytest

from terravane.operators import georeference, structures
from terravane.sources import logs, products


def test_stored_results_and_baselines(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", 1), ("b", 2)], "survey_id string, v int")

    for key in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert products.stored(spark, str(tmp_path / "kept"), key, build).count() == 2
    assert len(built) == 2
    folder = str(tmp_path / "base")
    products.save_baseline(build(), folder, "a", "one")
    assert [tuple(r) for r in products.save_baseline(build(), folder, "b", "two").collect()] == [("b", 2, "two")]
    assert products.delete_baseline(spark, folder, "one") and not products.delete_baseline(spark, folder, "one")
    assert spark.read.parquet(folder).count() == 1
    for name in ("", "../x", "a/b", "a=b"):
        with pytest.raises(ValueError):
            products.delete_baseline(spark, folder, name)


def test_images_and_page(spark):
    cells = spark.createDataFrame([(5, 7, 0.0), (6, 9, 10.0), (6, 7, None)], "i bigint, j bigint, h double")
    image = products.layer_image(cells.select("i", "j", *products.shaded("h", 0.0, 10.0)))
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (3, 2)
    at = image.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(image[at + 4 : at + 4 + struct.unpack(">I", image[at - 4 : at])[0]]), dtype=np.uint8).reshape(2, 13)[:, 1:].reshape(2, 3, 4)
    assert raw[0, 0].tolist() == [33, 62, 160, 255] and raw[1, 2].tolist() == [190, 30, 45, 255] and raw[1, 0, 3] == raw[0, 1, 3] == 0
    with pytest.raises(ValueError):
        products.layer_image(cells.select("i", "j", *products.shaded("h", 0.0, 10.0)), most=5)
    assert products.layer_image(cells.limit(0).select("i", "j", *products.shaded("h", 0.0, 1.0)))[:4] == b"\x89PNG"
    page = products.quality_page("A <b>", [("error", 0.5, 1.0), ("time", 3.0, 1.0), ("none", None, 1.0)], {"facts": {"x": float("nan"), "y": 2}})
    assert "A &lt;b&gt;" in page and page.count("met<") == 1 and "missed" in page and "<th>y</th><td>2</td>" in page and "nan" not in page


def lines(spark, files):
    rows = [(f, k, x) for f, text in files.items() for k, x in enumerate(text)]
    return spark.createDataFrame([(*r, "x") for r in rows], "file string, line_no bigint, value string, names string")


def test_trajectories(spark):
    us = ["Time\tLat\tLon\tAlt_FT"] + [f"{1_700_000_000_000_000 + k * 500_000}\t45.{k:02d}\t29.5\t{100 + k}" for k in range(25)]
    ned = ['"timestamp","x","y","z"', "0.0,0,0,-10", "", "0.5,bad,111.0,-11", "1.0,1111.95,0,-12"]
    got = sorted(map(tuple, logs.trajectory_csv(lines(spark, {"a": us, "b": ned, "c": ["t,lat"], "d": []}), every=10, origin=(45.0, 29.0)).collect()))
    assert [r[1] for r in got if r[0] == "a"] == [1, 11, 21, 25] and {r[0] for r in got} == {"a", "b"}
    a = [r for r in got if r[0] == "a"]
    assert a[1][2] - a[0][2] == pytest.approx(5.0) and a[0][5] == pytest.approx(30.48)
    b = [r for r in got if r[0] == "b"]
    assert b[0][2:] == (0.0, 45.0, 29.0, 10.0) and b[-1][3] == pytest.approx(45.01, abs=1e-4)


def test_flight_records(spark):
    rows = ["time(millisecond),latitude,longitude,height_above_takeoff(feet),isVideo,gimbal_pitch(degrees)", "1000,0,0,1,0,", "2000,45.1,29.1,10,0,-60", "3000,45.2,29.2,20,1,-61", "4000,45.3,29.3,x,1,"]
    got = sorted(map(tuple, logs.flight_record_csv(lines(spark, {"f": rows})).collect()))
    assert [r[2] for r in got] == [-1.0, 0.0, 1.0] and got[0][5] == pytest.approx(3.048) and got[2][5] is None and got[1][6] == -61.0


def test_waypoint_documents_and_cameras(spark):
    texts = [("a", '{"georeference": {"x": 1}, "waypoints": [{"time_s": 1.5, "latitude": 45.0}, {"frame_id": 9}]}'), ("b", '[{"frame_id": 3, "longitude": 2.5}]'), ("c", "no json"), ("d", None), ("e", "{}")]
    got = sorted((r.file, r.frame_id, r.time_s, r.latitude, r.longitude) for r in logs.telemetry_json(spark.createDataFrame(texts, "file string, value string")).collect())
    assert got == [("a", 0, 1.5, 45.0, None), ("a", 9, None, None, None), ("b", 3, None, None, 2.5)]
    cams = [
        ("list", "# c\n1 OPENCV 640 480 500.0 501.0 320 240 0.1 0 0 0\n"), ("simple", "1 SIMPLE_RADIAL 640 480 500 320 240 0\n"), ("yaml", "camera_matrix: !!opencv-matrix\n  rows: 3\n  cols: 3\n  dt: d\n  data: [ 500., 0., 320., 0., 501., 240., 0., 0., 1. ]\ndistortion_coefficients:\n  data: [ 0., 0., 0., 0. ]\n"),
        ("plain", '{"fx": 900, "fy": 901, "cx": 512, "cy": 256, "k1": -0.2}'), ("none", "hello"), ("null", None),
    ]
    got = {r.file: (r.model, r.width, r.height, r.fx, r.fy, r.cx, r.cy) for r in logs.intrinsics(spark.createDataFrame(cams, "file string, value string")).collect()}
    assert got["list"] == ("OPENCV", 640, 480, 500, 501, 320, 240) and got["simple"] == ("PINHOLE", 640, 480, 500, 500, 320, 240)
    assert got["yaml"] == ("PINHOLE", 640, 480, 500, 501, 320, 240) and got["plain"] == ("OPENCV", 1024, 512, 900, 901, 512, 256) and set(got) == {"list", "simple", "yaml", "plain"}


def test_planted_georeference(spark):
    """A turned and scaled track, stored in either order, with spikes, is found with its order."""
    rng = np.random.default_rng(2)
    rows, truth = [], {"a": (False, 1.4, 30.0), "b": (True, 0.8, -110.0)}
    for survey, (swapped, scale, turn) in truth.items():
        x, z = np.cumsum(rng.normal(0, 8, (2, 200)), axis=1)
        c, s = scale * np.cos(np.radians(turn)), scale * np.sin(np.radians(turn))
        e, n = c * x - s * -z + rng.normal(0, 0.3, 200), s * x + c * -z + rng.normal(0, 0.3, 200)
        lat, lon = 45.0 + np.degrees(n / 6371000), 29.0 + np.degrees(e / (6371000 * np.cos(np.radians(45.0))))
        lat[::40] += 0.05
        rows += [(survey, float(a), float(b), *map(float, (q, p) if swapped else (p, q))) for a, b, p, q in zip(x, z, lat, lon)]
    rows += [("c", 1.0, 1.0, 45.0, 29.0)]
    fits = georeference.order_fits(spark.createDataFrame(rows, "survey_id string, x double, z double, lat double, lon double"))
    got = {r.survey_id: r for r in georeference.solved(fits).collect()}
    assert set(got) == {"a", "b"}
    for survey, (swapped, scale, turn) in truth.items():
        r = got[survey]
        assert r.swapped == swapped and r.scale == pytest.approx(scale, rel=0.01) and r.turn_deg == pytest.approx(turn, abs=0.5)
        assert r.rmse < 0.8 and r.pairs == 195 and r.confidence == "HIGH"


def test_farthest_points_and_reference_surface(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (60, 2))
    df = spark.createDataFrame([("s", k, float(x), float(z)) for k, (x, z) in enumerate(p)], "survey_id string, pid bigint, x double, z double")
    away = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    chosen = [0]
    for _ in range(4):
        gap = away[chosen].min(axis=0)
        chosen.append(int(gap.argmax()))
    got = sorted((r["rank"], r.pid) for r in structures.farthest_points(df, 5).collect())
    assert got == list(enumerate(chosen))
    assert structures.farthest_points(df.limit(0), 3).count() == 0
    flat = [("s", i, j, 10 + 0.01 * i + float(rng.normal(0, 0.01)) - (1.0 if 8 <= i <= 10 and 8 <= j <= 10 else 0.0)) for i in range(25) for j in range(25)]
    out = structures.reference_surface(spark.createDataFrame(flat, "survey_id string, i bigint, j bigint, h double"), "h", 1.5).toPandas()
    dip = out[out.i.between(8, 10) & out.j.between(8, 10)]
    assert not dip.used.any() and (dip.reference - (10 + 0.01 * dip.i)).abs().max() < 0.1
