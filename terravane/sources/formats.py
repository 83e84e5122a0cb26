"""Readers of survey file formats: point clouds, subtitle and receiver logs, camera models.

Text formats are parsed with column expressions. Binary ones are Python data sources that read byte
ranges: a vertex block is cut into slices of whole records, so a large cloud has many tasks.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
COLOURS = {"red": "r", "green": "g", "blue": "b", "r": "r", "g": "g", "b": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b"}
POINT_SCHEMA = "pid bigint, x double, y double, z double, r int, g int, b int, nx double, ny double, nz double"


def ply_header(path: str) -> dict:
    """Format, elements with their properties, and the offset of the data."""
    elements: list[dict] = []
    kind, offset = "", 0
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is no PLY file")
        for _ in range(10_000):
            words = f.readline().decode("ascii", "replace").split()
            if not words or words[0] == "comment":
                continue
            if words[0] == "format":
                kind = words[1]
            elif words[0] == "element":
                elements.append({"name": words[1], "count": int(words[2]), "properties": []})
            elif words[0] == "property":
                elements[-1]["properties"].append((words[-1], words[1] if words[1] != "list" else tuple(words[1:4])))
            elif words[0] == "end_header":
                offset = f.tell()
                break
    return {"format": kind, "elements": elements, "offset": offset}


def ply_counts(path: str) -> tuple[int, int]:
    """Vertices and faces from the header alone; (0, 0) where the file cannot be read."""
    try:
        counts = {e["name"]: e["count"] for e in ply_header(path)["elements"]}
    except (OSError, ValueError):
        return 0, 0
    return counts.get("vertex", 0), counts.get("face", 0)


class Slice(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        self.path, self.first, self.count = path, first, count


def _points(columns: dict[str, np.ndarray], first: int) -> pa.RecordBatch:
    n = len(columns["x"])
    out: dict[str, pa.Array] = {"pid": pa.array(first + np.arange(n), pa.int64())}
    for c in "xyz":
        out[c] = pa.array(columns[c].astype(np.float64))
    named = {COLOURS[k]: v for k, v in columns.items() if k in COLOURS}
    for c in "rgb":
        v = named.get(c)
        if v is not None and v.dtype.kind == "f" and (not len(v) or v.max() <= 1):
            v = v * 255
        out[c] = pa.nulls(n, pa.int32()) if v is None else pa.array(v.astype(np.int32))
    for c in ("nx", "ny", "nz"):
        out[c] = pa.array(columns[c].astype(np.float64)) if c in columns else pa.nulls(n, pa.float64())
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


class PlyReader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        paths = [os.path.join(self.path, p) for p in sorted(os.listdir(self.path)) if p.endswith(".ply")] if os.path.isdir(self.path) else [self.path]
        out: list[InputPartition] = []
        for path in paths:
            head = ply_header(path)
            count = next((e["count"] for e in head["elements"] if e["name"] == "vertex"), 0)
            step = count if head["format"] == "ascii" else self.rows
            out += [Slice(path, a, min(step, count - a)) for a in range(0, count, max(step, 1))]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        head = ply_header(partition.path)
        if head["elements"][0]["name"] != "vertex":
            raise ValueError("the vertex block must come first")
        properties = head["elements"][0]["properties"]
        if any(isinstance(kind, tuple) for _, kind in properties):
            raise ValueError("vertices with lists are not supported")
        if head["format"] == "ascii":
            with open(partition.path, "rb") as f:
                f.seek(head["offset"])
                rows = [f.readline().split()[: len(properties)] for _ in range(partition.count)]
            columns = {name: np.array([r[k] for r in rows], dtype=PLY_TYPES[kind]) for k, (name, kind) in enumerate(properties)}
        else:
            order = ">" if head["format"] == "binary_big_endian" else "<"
            record = np.dtype([(name, order + PLY_TYPES[kind]) for name, kind in properties])
            with open(partition.path, "rb") as f:
                f.seek(head["offset"] + partition.first * record.itemsize)
                data = np.frombuffer(f.read(partition.count * record.itemsize), dtype=record)
            columns = {name: data[name].astype(record[name].newbyteorder("=")) for name, _ in properties}
        batch = _points(columns, partition.first)
        for at in range(0, batch.num_rows, 50_000):
            yield batch.slice(at, 50_000)


class PlySource(DataSource):
    """``spark.read.format("ply").load(path)``: a file or a folder of files; option ``rows`` a slice."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return POINT_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(self.options["path"], int(self.options.get("rows", 1_000_000)))


def colmap_images(path: str) -> Iterator[tuple]:
    """Records of a binary images file: id, name, quaternion w x y z, translation, camera id, centre."""
    with open(path, "rb") as f:
        (count,) = struct.unpack("<Q", f.read(8))
        for _ in range(count):
            image, *pose, camera = struct.unpack("<I7dI", f.read(64))
            name = b""
            while (c := f.read(1)) not in (b"\0", b""):
                name += c
            (points,) = struct.unpack("<Q", f.read(8))
            f.seek(points * 24, os.SEEK_CUR)
            q, t = np.array(pose[:4]), np.array(pose[4:])
            if abs(np.linalg.norm(q) - 1) > 0.05:
                continue
            w, x, y, z = q / np.linalg.norm(q)
            r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
            centre = -r.T @ t
            yield (image, name.decode("utf-8", "replace"), *map(float, (w, x, y, z)), *map(float, t), camera, *map(float, centre))


#: Camera models by number, with their count of parameters and the place of the vertical focal length.
CAMERA_MODELS = [("SIMPLE_PINHOLE", 3, 0), ("PINHOLE", 4, 1), ("SIMPLE_RADIAL", 4, 0), ("RADIAL", 5, 0), ("OPENCV", 8, 1), ("OPENCV_FISHEYE", 8, 1), ("FULL_OPENCV", 12, 1), ("FOV", 5, 1), ("SIMPLE_RADIAL_FISHEYE", 4, 0), ("RADIAL_FISHEYE", 5, 0), ("THIN_PRISM_FISHEYE", 12, 1)]


def colmap_cameras(path: str) -> Iterator[tuple]:
    """Records of a binary cameras file: id, model, width, height, vertical focal length, parameters."""
    with open(path, "rb") as f:
        (count,) = struct.unpack("<Q", f.read(8))
        for _ in range(count):
            camera, model, width, height = struct.unpack("<IiQQ", f.read(24))
            name, n, focal = CAMERA_MODELS[model]
            params = list(struct.unpack(f"<{n}d", f.read(8 * n)))
            yield camera, name, width, height, params[focal], params


def colmap_points(path: str) -> Iterator[tuple]:
    """Records of a binary sparse points file: id, position, colour in 0..1, number of views."""
    with open(path, "rb") as f:
        (count,) = struct.unpack("<Q", f.read(8))
        for _ in range(count):
            point, x, y, z, r, g, b, _error, views = struct.unpack("<Q3d3BdQ", f.read(51))
            f.seek(views * 8, os.SEEK_CUR)
            yield point, x, y, z, r / 255, g / 255, b / 255, views


COLMAP = {
    "images": (colmap_images, "image_id int, name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, cx double, cy double, cz double"),
    "cameras": (colmap_cameras, "camera_id int, model string, width bigint, height bigint, focal double, params array<double>"),
    "points3D": (colmap_points, "point_id bigint, x double, y double, z double, r double, g double, b double, views bigint"),
}


class ColmapReader(DataSourceReader):
    def __init__(self, path: str, table: str) -> None:
        self.path, self.table = path, table

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from COLMAP[self.table][0](os.path.join(self.path, f"{self.table}.bin"))


class ColmapSource(DataSource):
    """``spark.read.format("colmap").option("table", "images").load(folder)``; records of running length, so one task a file."""

    @classmethod
    def name(cls) -> str:
        return "colmap"

    def schema(self) -> str:
        return COLMAP[self.options.get("table", "images")][1]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ColmapReader(self.options["path"], self.options.get("table", "images"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)
    spark.dataSource.register(ColmapSource)


NUMBER = r"(-?\d+(?:\.\d+)?)"


def subtitle_log(texts: DataFrame, text: str = "value") -> DataFrame:
    """Cues of subtitle flight logs, one row each: (file, cue, time_s, clock, a, b, third, barometer, rel_alt, abs_alt, height, pitch, yaw).

    ``texts`` has one row for each file (``spark.read.text(path, wholetext=True)``) and a column file.
    Altitude falls back from the relative one to the height, the barometer and the third GPS value.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"\r", ""), r"<[^>]*>", "")
    cues = texts.select("file", F.posexplode(F.split(clean, r"\n\s*\n")).alias("cue", "body")).where(F.col("body").contains("-->"))
    get = lambda pattern, k=1: F.nullif(F.regexp_extract("body", pattern, k), F.lit("")).try_cast("double")
    stamp = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->"
    gps = rf"GPS\s*\(\s*{NUMBER}\s*,\s*{NUMBER}\s*(?:,\s*{NUMBER}\s*)?"
    out = cues.select(
        "file", "cue", (get(stamp, 1) * 3600 + get(stamp, 2) * 60 + get(stamp, 3) + get(stamp, 4) / 1000).alias("time_s"),
        F.nullif(F.regexp_extract("body", r"(\d{4}[-.]\d{1,2}[-.]\d{1,2} \d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?)", 1), F.lit("")).alias("clock"),
        F.coalesce(get(rf"latitude\s*:?\s*{NUMBER}"), get(gps, 1)).alias("a"), F.coalesce(get(rf"long?t?i?tude\s*:?\s*{NUMBER}"), get(gps, 2)).alias("b"), get(gps, 3).alias("third"),
        get(rf"BAROMETER\s*:?\s*{NUMBER}").alias("barometer"), get(rf"rel_alt\s*:?\s*{NUMBER}").alias("rel_alt"), get(rf"abs_alt\s*:?\s*{NUMBER}").alias("abs_alt"), get(rf"\bH\s*:?\s*{NUMBER}\s*m").alias("height"),
        get(rf"gb_pitch\s*:?\s*{NUMBER}").alias("pitch"), get(rf"gb_yaw\s*:?\s*{NUMBER}").alias("yaw"),
    )
    counts = out.groupBy("file").agg(
        F.coalesce(F.bool_and(F.col("third").between(0, 40) & (F.col("third") == F.floor("third"))) & F.bool_or(F.col("barometer").isNotNull()), F.lit(False)).alias("satellites"),
        F.coalesce(F.bool_or(F.abs("a") > 90), F.lit(False)).alias("lon_first"), F.coalesce(F.bool_or(F.abs("b") > 90), F.lit(False)).alias("lat_first"),
    )
    fixed = out.join(counts, "file")
    altitude = F.coalesce("rel_alt", "height", "barometer", F.when(~F.col("satellites"), F.col("third")))
    pick = lambda p, q: F.when(F.col("lon_first"), F.col(p)).otherwise(F.col(q))
    return fixed.select("file", "cue", "time_s", "clock", pick("b", "a").alias("latitude"), pick("a", "b").alias("longitude"), altitude.alias("altitude_m"), "abs_alt", "pitch", "yaw", (~(F.col("lon_first") | F.col("lat_first"))).alias("ambiguous"))


def receiver_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Epochs of receiver solution files: (file, t, lat, lon, h, q); calendar or week-and-seconds time.

    Comment lines go; positions are geodetic, or geocentric where the first number is beyond 400.
    """
    from terravane.functions.geodesy import from_ecef

    rows = lines.where(~F.trim(line).startswith("%") & (F.length(F.trim(line)) > 0)).select("file", F.split(F.trim(line), r"[\s,]+").alias("w"))
    calendar = F.get("w", F.lit(0)).contains("/")
    at = lambda k: F.get("w", F.lit(k)).try_cast("double")
    date = F.to_timestamp(F.concat_ws(" ", F.get("w", F.lit(0)), F.regexp_extract(F.get("w", F.lit(1)), r"^(\d+:\d+:\d+)", 1)), "yyyy/MM/dd HH:mm:ss")
    part = F.coalesce(F.nullif(F.regexp_extract(F.get("w", F.lit(1)), r"(\.\d+)$", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    t = F.when(calendar, F.unix_timestamp(date) + part).otherwise(315964800 + at(0) * 604800 + at(1))
    p = rows.select("file", t.alias("t"), at(2).alias("x"), at(3).alias("y"), at(4).alias("z"), at(5).cast("int").alias("q")).where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    lat, lon, h = from_ecef(F.col("x"), F.col("y"), F.col("z"))
    ecef = F.abs("x") > 400
    return p.select("file", "t", F.when(ecef, lat).otherwise(F.col("x")).alias("lat"), F.when(ecef, lon).otherwise(F.col("y")).alias("lon"), F.when(ecef, h).otherwise(F.col("z")).alias("h"), "q")
