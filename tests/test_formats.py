import json
import struct

import numpy as np

from terravane.sources import formats, sinks


def test_ply_round_trip(spark, tmp_path):
    formats.register(spark)
    spark.dataSource.register(sinks.PlySink)
    rows = [(float(k), k / 7, -float(k), k % 256, 2, 3) for k in range(1000)]
    df = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int").repartition(3)
    folder = str(tmp_path / "cloud")
    df.write.format("plyfile").mode("append").save(folder)
    got = spark.read.format("ply").option("rows", 100).load(folder)
    assert sorted((r.x, r.y, r.z, r.r, r.g, r.b) for r in got.collect()) == sorted(rows)
    text = tmp_path / "a.ply"
    text.write_text("ply\nformat ascii 1.0\ncomment x\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty float red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n1 2 3 0.5\n4 5 6 1\n3 0 1 0\n")
    assert formats.ply_counts(str(text)) == (2, 1) and formats.ply_counts(str(tmp_path / "none")) == (0, 0)
    assert [(r.x, r.r, r.g) for r in spark.read.format("ply").load(str(text)).collect()] == [(1.0, 127, None), (4.0, 255, None)]


def test_colmap(spark, tmp_path):
    formats.register(spark)
    images = struct.pack("<Q", 1) + struct.pack("<I7dI", 7, 1, 0, 0, 0, 1, 2, 3, 1) + b"a.jpg\0" + struct.pack("<Q", 1) + struct.pack("<2dQ", 0, 0, 5)
    (tmp_path / "images.bin").write_bytes(images)
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<IiQQ4d", 1, 1, 640, 480, 500, 501, 320, 240))
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ", 9, 1, 2, 3, 255, 0, 0, 0.5, 1) + struct.pack("<II", 7, 0))
    load = lambda t: spark.read.format("colmap").option("table", t).load(str(tmp_path)).first()
    assert (load("images").name, load("images").cx, load("images").cz) == ("a.jpg", -1.0, -3.0)
    assert load("cameras").focal == 501 and load("points3D").r == 1.0


def test_subtitles(spark):
    new = "\n\n".join(f"{k}\n00:00:{k:02d},500 --> 00:00:{k + 1:02d},000\n<font>2024-05-01 10:00:{k:02d}.250 GPS({45 + k / 100}, 29.5, {80 + k}.5) [gb_pitch: -60.5]</font>" for k in range(1, 4))
    old = "\n\n".join(f"{k}\n00:00:{k:02d},000 --> 00:00:{k + 1:02d},000\nHOME(100.1,28.2) 2017.05.01 10:00:00\nGPS(100.2,28.{k},15) BAROMETER:31.{k}" for k in range(1, 4))
    df = spark.createDataFrame([("new", new), ("old", old), ("none", ""), ("null", None)], "file string, value string")
    got = {(r.file, r.cue): r for r in formats.subtitle_log(df).collect()}
    assert len(got) == 6
    a, b = got["new", 0], got["old", 0]
    assert (a.time_s, a.latitude, a.longitude, a.altitude_m, a.pitch, a.ambiguous) == (1.5, 45.01, 29.5, 81.5, -60.5, True) and a.clock == "2024-05-01 10:00:01.250"
    assert (b.latitude, b.longitude, b.altitude_m, b.ambiguous) == (28.1, 100.2, 31.1, False)


def test_receiver_log(spark):
    lines = ["% header", "2024/05/01 10:00:00.500 45.1 29.1 12.5 1 9", "2312 381600.5 45.1 29.1 12.5 2 9", "2312 381601.5 3939823.0 2192849.0 4495383.0 5 9", "", "bad line"]
    df = spark.createDataFrame([("f", x) for x in lines], "file string, value string")
    got = sorted(formats.receiver_log(df).collect(), key=lambda r: r.t)
    assert len(got) == 3 and got[0].t == 1714557600.5 - 0 and got[-1].q in (1, 2, 5)
    far = next(r for r in got if r.q == 5)
    assert 40 < far.lat < 50 and 20 < far.lon < 40 and abs(far.h) < 20000


def test_las(spark, tmp_path):
    spark.dataSource.register(sinks.LasSink)
    rng = np.random.default_rng(0)
    xyz = rng.uniform(0, 50, (100, 3)) + [4_100_000.0, 0.0, 500_000.0]
    rows = [(*map(float, p), k % 256, 2, 3, 6) for k, p in enumerate(xyz)]
    df = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int, cls int").coalesce(1)
    df.write.format("lasfile").option("epsg", 32635).mode("append").save(str(tmp_path / "las"))
    (name,) = [f for f in (tmp_path / "las").iterdir()]
    data = name.read_bytes()
    at, n = struct.unpack("<I", data[96:100])[0], struct.unpack("<I", data[107:111])[0]
    assert data[:4] == b"LASF" and n == 100 and len(data) == at + 100 * 34 and b"LASF_Projection" in data[:at]
    scale, offset = np.array(struct.unpack("<3d", data[131:155])), np.array(struct.unpack("<3d", data[155:179]))
    points = np.frombuffer(data[at:], dtype=sinks.LAS_POINT)
    assert np.abs(points["p"] * scale + offset - xyz).max() <= 0.0006
    assert points["cls"].tolist() == [6] * 100 and points["rgb"][:, 0].tolist() == [k % 256 * 257 for k in range(100)]
    ends = np.array(struct.unpack("<6d", data[179:227])).reshape(3, 2)
    assert np.allclose(ends[:, 0], xyz.max(axis=0)) and np.allclose(ends[:, 1], xyz.min(axis=0))
    df.limit(0).write.format("lasfile").mode("append").save(str(tmp_path / "none"))
    assert not list((tmp_path / "none").iterdir())


def tags_of(tif):
    (count,) = struct.unpack("<H", tif[8:10])
    out = {}
    for k in range(count):
        tag, kind, n = struct.unpack("<HHI", tif[10 + 12 * k : 18 + 12 * k])
        form = {2: "s", 3: "H", 4: "I", 12: "d"}[kind]
        size = struct.calcsize(f"<{n}{form}")
        at = 18 + 12 * k if size <= 4 else struct.unpack("<I", tif[18 + 12 * k : 22 + 12 * k])[0]
        out[tag] = struct.unpack(f"<{n}{form}", tif[at : at + size])
    return out


def test_geotiff(spark, tmp_path):
    import zlib

    rng = np.random.default_rng(0)
    raster = rng.normal(size=(37, 53)).astype(np.float32)
    raster[3, 4] = np.nan
    tif = sinks.geotiff(raster, 1000.0, 2000.0, 0.5, 32635, side=16)
    tags = tags_of(tif)
    assert tags[256] == (53,) and tags[257] == (37,) and tags[34735][-1] == 32635 and tags[33922][3:5] == (1000.0, 2000.0)
    blocks = [np.frombuffer(zlib.decompress(tif[a : a + n]), dtype="<f4").reshape(16, 16) for a, n in zip(tags[324], tags[325])]
    image = np.block([[blocks[4 * a + b] for b in range(4)] for a in range(3)])[:37, :53]
    assert image[3, 4] == -9999 and np.array_equal(np.where(np.isnan(raster), -9999, raster), image)
    cells = spark.createDataFrame([("s", i, j, float(raster[i, j])) for i in range(37) for j in range(53) if (i, j) != (3, 4)], "survey_id string, i bigint, j bigint, h double")
    files = sinks.write_rasters(cells, "h", str(tmp_path / "tif"), 0.5, 32635, (1000.0, 2000.0), tile=32).collect()
    assert len(files) == 4
    corner = tags_of(open(next(f.path for f in files if (f.ti, f.tj) == (1, 1)), "rb").read())
    assert corner[33922][3:5] == (1016.0, 1984.0)


def test_geojson_and_cityjson(spark):
    df = spark.createDataFrame([("s", 2, 29.123456789, 45.0), ("s", 1, 29.0, 45.1)], "survey_id string, t int, lon double, lat double")
    f = json.loads(sinks.geojson_features(df, "lon", "lat", ["t"], "pothole").first()["feature"])
    assert f["geometry"]["coordinates"] == [29.1234568, 45.0] and f["properties"] == {"layer": "pothole", "t": 2}
    line = json.loads(sinks.geojson_line(df, ["survey_id"], ["t"], "lon", "lat").first()["feature"])
    assert line["geometry"]["coordinates"] == [[29.0, 45.1], [29.1234568, 45.0]]
    square = [(0, 0), (4, 0), (4, 3), (0, 3)]
    doc = json.loads(sinks.city_json([{"footprint": square, "ground": 1, "top": 5.5, "name": "a"}, {"footprint": square, "ground": 0, "top": 2, "name": "b"}]))
    assert len(doc["vertices"]) == 16 and doc["vertices"][4] == [0, 0, 5500] and doc["CityObjects"]["b"]["geometry"][0]["boundaries"][0][1] == [[12, 13, 14, 15]]
    assert json.loads(sinks.city_json([]))["vertices"] == []
