"""Writers of survey formats. Files are written under a hidden name and renamed when whole."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class PlyWriter(DataSourceWriter):
    """One binary little-endian file for each partition; ``commit`` gives them their names."""

    def __init__(self, path: str) -> None:
        self.path = path
        os.makedirs(path, exist_ok=True)

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}")
        record = np.dtype([(c, "<f8") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue")])
        count = 0
        with open(name, "wb") as f:
            buffer = []
            for r in rows:
                buffer.append((r.x, r.y, r.z, r.r, r.g, r.b))
                if len(buffer) == 50_000:
                    f.write(np.array(buffer, dtype=record).tobytes())
                    count += len(buffer)
                    buffer = []
            f.write(np.array(buffer, dtype=record).tobytes())
            count += len(buffer)
        return Part(name, count)

    def commit(self, messages: list) -> None:
        for n, part in enumerate(m for m in messages if m is not None):
            head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {part.rows}\n" + "".join(f"property double {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
            final = os.path.join(self.path, f"part-{n:05d}.ply")
            with open(final + ".tmp", "wb") as out, open(part.path, "rb") as body:
                out.write(head.encode())
                while chunk := body.read(1 << 22):
                    out.write(chunk)
            os.replace(final + ".tmp", final)
            os.remove(part.path)

    def abort(self, messages: list) -> None:
        for part in messages:
            if part is not None and os.path.exists(part.path):
                os.remove(part.path)


class PlySink(DataSource):
    """``df.write.format("plyfile").mode("append").save(folder)`` with x, y, z, r, g, b."""

    @classmethod
    def name(cls) -> str:
        return "plyfile"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PlyWriter(self.options["path"])


def quantised(points: DataFrame, scale: float = 0.001) -> DataFrame:
    """Integer coordinates, 16-bit colours and intensity of exchange formats, as expressions.

    The offsets are the floors of each survey's minima, joined as one row for each survey.
    """
    low = points.groupBy("survey_id").agg(*[F.floor(F.min(c)).alias(f"{c}0") for c in "xyz"])
    q = points.join(low, "survey_id")
    whole = [F.round((F.col(c) - F.col(f"{c}0")) / scale).cast("bigint").alias(f"q{c}") for c in "xyz"]
    luma = (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) * 257
    return q.select("survey_id", *whole, *[(F.col(c) * 257).cast("int").alias(f"{c}16") for c in "rgb"], F.floor(luma).cast("int").alias("intensity"))


#: Record of LAS point format 3.
LAS_POINT = np.dtype([("p", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("time", "<f8"), ("rgb", "<u2", 3)])


def las_header(n: int, scale: float, offset: np.ndarray, low: np.ndarray, high: np.ndarray, epsg: int | None) -> bytes:
    """LAS 1.2 header, with a GeoTIFF key record where a projection is given."""
    keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg) if epsg else b""
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys if epsg else b""
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"survey", b"terravane", 1, 2024, 227, 227 + len(record), bool(epsg), 3, LAS_POINT.itemsize, n, n, 0, 0, 0, 0)
    return head + struct.pack("<12d", *[scale] * 3, *offset, *np.c_[high, low].ravel()) + record


class LasWriter(DataSourceWriter):
    """One LAS file for each partition; x, y, z and, where the rows have them, r, g, b and cls."""

    def __init__(self, options: dict) -> None:
        self.path, self.scale = options["path"], float(options.get("scale", 0.001))
        self.epsg = int(options["epsg"]) if "epsg" in options else None
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}")
        offset, low, high, count = None, np.full(3, np.inf), np.full(3, -np.inf), 0
        with open(name, "wb") as f:
            while chunk := list(islice(rows, 50_000)):
                field = lambda k: np.array([(r[k] if k in r and r[k] is not None else 0) for r in chunk])
                xyz = np.stack([field(k).astype(float) for k in "xyz"], axis=1)
                # whole multiples of a hundred metres near the first point keep integers small in any projection
                offset = np.round(xyz[0] / 100) * 100 if offset is None else offset
                data = np.zeros(len(chunk), dtype=LAS_POINT)
                data["p"] = np.rint((xyz - offset) / self.scale)
                data["rgb"] = np.stack([field(k).astype(np.uint16) for k in "rgb"], axis=1) * 257
                data["cls"], data["flags"] = field("cls"), 0b001001
                f.write(data.tobytes())
                low, high, count = np.minimum(low, xyz.min(axis=0)), np.maximum(high, xyz.max(axis=0)), count + len(chunk)
        if count:
            head = las_header(count, self.scale, offset, low, high, self.epsg)
            with open(name + ".whole", "wb") as out, open(name, "rb") as body:
                out.write(head)
                while piece := body.read(1 << 22):
                    out.write(piece)
            os.replace(name + ".whole", name)
        return Part(name, count)

    def commit(self, messages: list) -> None:
        for n, part in enumerate(m for m in messages if m is not None):
            if part.rows:
                os.replace(part.path, os.path.join(self.path, f"part-{n:05d}.las"))
            else:
                os.remove(part.path)

    abort = PlyWriter.abort


class LasSink(DataSource):
    """``df.write.format("lasfile").option("epsg", 32635).mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "lasfile"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LasWriter(self.options)


def geotiff(raster: np.ndarray, x0: float, y0: float, res: float, epsg: int, nodata: float = -9999.0, side: int = 256) -> bytes:
    """One float32 band, north up, in deflated square tiles."""
    rows, cols = raster.shape
    down, across = -(-rows // side), -(-cols // side)
    whole = np.full((down * side, across * side), nodata, dtype="<f4")
    whole[:rows, :cols] = np.where(np.isnan(raster), nodata, raster)
    tiles = [zlib.compress(whole[a * side : (a + 1) * side, b * side : (b + 1) * side].tobytes()) for a in range(down) for b in range(across)]
    sizes = [len(t) for t in tiles]
    short, long_, double, text = ("<H", 3), ("<I", 4), ("<d", 12), ("", 2)
    fields = {
        256: (long_, [cols]), 257: (long_, [rows]), 258: (short, [32]), 259: (short, [8]), 262: (short, [1]), 277: (short, [1]), 322: (long_, [side]), 323: (long_, [side]), 324: (long_, sizes), 325: (long_, sizes), 339: (short, [3]),
        33550: (double, [res, res, 0]), 33922: (double, [0, 0, 0, x0, y0, 0]), 34735: (short, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]), 42113: (text, f"{nodata:g}\0".encode()),
    }
    pack = lambda kind, values: bytes(values) if kind is text else b"".join(struct.pack(kind[0], v) for v in values)
    directory = 8 + 2 + 12 * len(fields) + 4
    body = directory + sum((n + 1) // 2 * 2 for n in (len(pack(*f)) for f in fields.values()) if n > 4)
    fields[324] = (long_, list(body + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)))
    entries, extra = b"", b""
    for tag, (kind, values) in fields.items():
        value = pack(kind, values)
        place = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", directory + len(extra))
        entries += struct.pack("<HHI", tag, kind[1], len(values)) + place
        extra += value + b"\0" * (len(value) % 2) if len(value) > 4 else b""
    return struct.pack("<2sHIH", b"II", 42, 8, len(fields)) + entries + b"\0\0\0\0" + extra + b"".join(tiles)


def write_rasters(raster: DataFrame, layer: str, folder: str, res: float, epsg: int, origin: tuple[float, float] = (0.0, 0.0), tile: int = 1024) -> DataFrame:
    """A GeoTIFF for each tile of each survey: (survey_id, ti, tj, path). Row i grows to the south.

    Tiles are written where they are, one file a task; nothing of a raster reaches the driver.
    """
    tiles = raster.where(F.col(layer).isNotNull()).select("survey_id", "i", "j", F.col(layer).cast("double").alias("v"), F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj, survey = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0]), str(pdf["survey_id"].iloc[0])
        image = np.full((tile, tile), np.nan)
        image[pdf["i"].to_numpy() - ti * tile, pdf["j"].to_numpy() - tj * tile] = pdf["v"].to_numpy()
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{survey}_{ti}_{tj}.tif")
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(geotiff(image, origin[0] + tj * tile * res, origin[1] - ti * tile * res, res, epsg))
        os.replace(f"{path}.{os.getpid()}", path)
        return pd.DataFrame({"survey_id": [survey], "ti": [ti], "tj": [tj], "path": [path]})

    return tiles.groupBy("survey_id", "ti", "tj").applyInPandas(work, "survey_id string, ti bigint, tj bigint, path string")


def geojson_features(layer: DataFrame, lon: str, lat: str, properties: list[str], kind: str) -> DataFrame:
    """One feature text for each row of a point layer; numbers of seven decimals."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 7), F.round(lat, 7)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(F.lit(kind).alias("layer"), *properties).alias("properties"))
    return layer.select(F.to_json(feature).alias("feature"))


def geojson_line(track: DataFrame, keys: list[str], order: list[str], lon: str, lat: str) -> DataFrame:
    """One line feature for each group, its points in order."""
    p = F.struct(*order, F.array(F.round(lon, 7), F.round(lat, 7)).alias("p"))
    lines = track.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(p)), lambda s: s["p"]).alias("line"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates"))
    return lines.select(*keys, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*keys).alias("properties"))).alias("feature"))


def city_block(footprint: list[tuple[float, float]], ground: float, top: float, name: str) -> dict:
    """An extruded footprint with ground, roof and wall surfaces; vertices in whole millimetres."""
    n = len(footprint)
    vertices = [[round(x * 1000), round(y * 1000), round(h * 1000)] for h in (ground, top) for x, y in footprint]
    shell = [[list(range(n))[::-1]], [list(range(n, 2 * n))]] + [[[k, (k + 1) % n, n + (k + 1) % n, n + k]] for k in range(n)]
    surfaces = [{"type": "GroundSurface"}, {"type": "RoofSurface"}, {"type": "WallSurface"}]
    semantics = {"surfaces": surfaces, "values": [[0, 1] + [2] * n]}
    geometry = {"type": "Solid", "lod": "1.2", "boundaries": [shell], "semantics": semantics}
    return {"type": "CityJSON", "version": "1.1", "transform": {"scale": [0.001] * 3, "translate": [0, 0, 0]}, "CityObjects": {name: {"type": "Building", "geometry": [geometry]}}, "vertices": vertices}


def city_json(buildings: list[dict]) -> str:
    """Blocks of one survey in one document."""
    out = None
    for b in buildings:
        block = city_block(b["footprint"], b["ground"], b["top"], b["name"])
        if out is None:
            out = block
            continue
        shift = len(out["vertices"])
        for name, thing in block["CityObjects"].items():
            shell = thing["geometry"][0]["boundaries"][0]
            thing["geometry"][0]["boundaries"][0] = [[[v + shift for v in ring] for ring in face] for face in shell]
            out["CityObjects"][name] = thing
        out["vertices"] += block["vertices"]
    return json.dumps(out or {"type": "CityJSON", "version": "1.1", "CityObjects": {}, "vertices": []})


def json_safe(column: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), column)


def top_view(points: DataFrame, cols: int = 200) -> DataFrame:
    """Colour of the highest point of each pixel of a north-up view."""
    from terravane.operators.grid import with_cell

    ends = points.groupBy("survey_id").agg(F.percentile("x", F.array(F.lit(0.005), F.lit(0.995))).alias("e"))
    p = points.join(ends, "survey_id").where(F.col("x").between(F.col("e")[0], F.col("e")[1]))
    return with_cell(p, 100.0 / cols).groupBy("survey_id", "i", "j").agg(F.max_by(F.struct("r", "g", "b"), F.struct("y", "r", "g", "b")).alias("c")).select("survey_id", F.col("i").alias("row"), F.col("j").alias("col"), "c.*")
