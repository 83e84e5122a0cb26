"""Products of a survey: the catalog of exports, stored results, baselines, layer images, the quality page."""

from __future__ import annotations

import hashlib
import html
import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Product, group and what it needs of a survey (points, mesh, georeference).
PRODUCTS = [
    ("points_ply", "cloud", "points"), ("points_las", "cloud", "georeference"), ("points_classified_las", "cloud", "georeference"), ("mesh_ply", "mesh", "mesh"), ("mesh_obj", "mesh", "mesh"), ("mesh_glb", "mesh", "mesh"),
    ("dtm_tif", "raster", "georeference"), ("dsm_tif", "raster", "georeference"), ("ndsm_tif", "raster", "georeference"), ("ortho_tif", "raster", "georeference"), ("classes_tif", "raster", "georeference"), ("objects_geojson", "vector", "georeference"),
    ("roads_geojson", "vector", "georeference"), ("track_geojson", "vector", "georeference"), ("buildings_cityjson", "vector", "georeference"), ("track_srt", "log", "points"), ("telemetry_json", "log", "points"), ("report_html", "report", "points"),
]


def export_catalog(surveys: DataFrame) -> DataFrame:
    """(survey_id, product, kind, available): what can be made of each survey (survey_id, points, mesh, georeference)."""
    rows = F.array(*[F.struct(F.lit(p).alias("product"), F.lit(g).alias("kind"), F.lit(n).alias("needs")) for p, g, n in PRODUCTS])
    each = surveys.withColumn("p", F.explode(rows))
    flag = F.when(F.col("p.needs") == "points", F.col("points")).when(F.col("p.needs") == "mesh", F.col("mesh")).otherwise(F.col("georeference"))
    return each.select("survey_id", "p.product", "p.kind", F.coalesce(flag, F.lit(False)).alias("available"))


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path and the path, whatever kind of storage it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored(spark: SparkSession, folder: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, kept in the folder under a hash of the key (inputs, sizes, times, settings).

    A finished table is read again; another key builds another one. The folder must be shared by all
    executors. A table without its mark of success was cut off and is written anew.
    """
    name = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{name}"
    fs, mark = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_baseline(table: DataFrame, folder: str, survey: str, name: str) -> DataFrame:
    """A snapshot of one survey's rows as the partition of a baseline; saving it again replaces it."""
    _checked(name)
    rows = table.where(F.col("survey_id") == survey).withColumn("baseline", F.lit(name))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("baseline").parquet(folder)
    return table.sparkSession.read.parquet(folder).where(F.col("baseline") == name)


def delete_baseline(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the baseline was there and is gone; names that could lead out of the folder are refused."""
    _checked(name)
    fs, place = _files(spark, f"{folder.rstrip('/')}/baseline={name}")
    return bool(fs.exists(place) and fs.delete(place, True))


def _checked(name: str) -> None:
    if not name or not all(c.isalnum() or c in "-_" for c in name):
        raise ValueError(f"no name of a baseline: {name!r}")


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGBA image."""
    rows, cols, _ = pixels.shape
    raw = np.concatenate([np.zeros((rows, 1), dtype=np.uint8), pixels.astype(np.uint8).reshape(rows, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def shaded(value: str, low: float, high: float) -> list:
    """Colour columns r, g, b, a of a layer from blue over yellow to red; transparent without a value."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - low) / (high - low)))
    ramp = [(0.0, (33, 62, 160)), (0.5, (240, 220, 90)), (1.0, (190, 30, 45))]
    out = []
    for k, name in enumerate("rgb"):
        a, b, c = (colour[k] for _, colour in ramp)
        out.append(F.round(F.when(t < 0.5, a + (b - a) * 2 * t).otherwise(b + (c - b) * (2 * t - 1))).cast("int").alias(name))
    return [*out, F.when(F.col(value).isNull(), 0).otherwise(255).alias("a")]


def layer_image(cells: DataFrame, most: int = 4_000_000) -> bytes:
    """The image of coloured cells (i, j, r, g, b, a) of one survey; above ``most`` pixels it must be coarsened first."""
    i0, i1, j0, j1 = cells.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    if i0 is None:
        return png(np.zeros((1, 1, 4), dtype=np.uint8))
    shape = (i1 - i0 + 1, j1 - j0 + 1)
    if shape[0] * shape[1] > most:
        raise ValueError(f"{shape[0]} x {shape[1]} cells are too many for an image")
    table = cells.select("i", "j", "r", "g", "b", "a").toPandas()
    pixels = np.zeros((*shape, 4), dtype=np.uint8)
    pixels[table["i"] - i0, table["j"] - j0] = table[["r", "g", "b", "a"]]
    return png(pixels)


def quality_page(title: str, targets: list[tuple[str, float | None, float]], sections: dict[str, dict]) -> str:
    """A page with targets (name, value, limit) and tables of facts; values that are missing or not finite show as a dash."""

    def show(v: object) -> str:
        if v is None or isinstance(v, float) and not np.isfinite(v):
            return "–"
        return html.escape(f"{v:.3f}" if isinstance(v, float) else str(v))

    rows = "".join(f"<tr><td>{html.escape(n)}</td><td>{show(v)}</td><td>{show(limit)}</td><td>{'–' if v is None else 'met' if v <= limit else 'missed'}</td></tr>" for n, v, limit in targets)
    parts = "".join(f"<h2>{html.escape(name)}</h2><table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{show(v)}</td></tr>" for k, v in facts.items()) + "</table>" for name, facts in sections.items())
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th>target</th><th>value</th><th>limit</th><th></th></tr>{rows}</table>{parts}</body></html>"
