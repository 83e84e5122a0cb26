"""Readers of delimited and JSON logs and of camera files, from texts under changing column names.

Each takes a DataFrame with a column ``file`` and either one row a line (``value``) or one row a file, so
``spark.read.text`` feeds them, and gives one schema. What can't be read becomes null; files without rows
give none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column names of trajectory tables, lower case, in order of preference.
TRAJECTORY = {
    "t": ["timestamp", "time_s", "time", "t", "#timestamp"],
    "lat": ["latitude", "lat", "gps_lat"],
    "lon": ["longitude", "lon", "lng", "long", "gps_lon"],
    "alt": ["altitude", "alt", "height", "elevation", "alt_m"],
    "alt_ft": ["altitude_ft", "alt_ft", "altitude_feet", "height_ft", "alt(ft)"],
    "north": ["x", "north", "pos_x", "p_x"],
    "east": ["y", "east", "pos_y", "p_y"],
    "down": ["z", "down", "pos_z", "p_z"],
}
#: Patterns of flight-record columns.
RECORD = {
    "ms": r"^time\(millisecond\)$|offsettime|^time_ms$",
    "lat": r"^latitude|osd\.latitude|^lat$",
    "lon": r"^longitude|osd\.longitude|^lon$",
    "height_ft": r"height_above_takeoff\(feet\)|osd\.height ?\[ft\]",
    "height_m": r"height_above_takeoff\(m|osd\.height ?\[m\]|^height_m$",
    "pitch": r"gimbal_pitch|gimbal\.pitch",
    "recording": r"isvideo|isrecording|camera\.isvideo",
}


def delimited(lines: DataFrame, line: str = "value") -> DataFrame:
    """(file, no, names, cells): rows of delimited files; the header is the first line, the separator tab, ; or ,.

    ``no`` is the row's number in its file from the column ``line_no``, which the lines must have.
    """
    lines = lines.select("file", "line_no", line)
    head = lines.groupBy("file").agg(F.min_by(line, "line_no").alias("head"), F.min("line_no").alias("first"))
    separator = F.when(F.col("head").contains("\t"), "\t").when(F.col("head").contains(";"), ";").otherwise(",")
    cut = lambda c: F.transform(F.split(c, F.concat(F.lit("["), F.col("sep"), F.lit("]"))), lambda x: F.trim(F.regexp_replace(x, '^[ "]+|[ "]+$', "")))
    head = head.withColumn("sep", separator).withColumn("names", F.transform(cut(F.col("head")), lambda x: F.lower(x))).drop("head")
    rows = lines.join(head, "file").where((F.col("line_no") > F.col("first")) & (F.length(F.trim(line)) > 0))
    return rows.select("file", (F.col("line_no") - F.col("first")).alias("no"), "names", cut(F.col(line)).alias("cells"))


def _at(place: Column) -> Column:
    return F.try_element_at("cells", F.when(place > 0, place).otherwise(F.lit(1_000_000)).cast("int"))


def by_name(names: list[str]) -> Column:
    """The cell under the first of the names that the header has."""
    place = F.lit(0)
    for name in reversed(names):
        place = F.when(F.array_contains("names", name), F.array_position("names", name)).otherwise(place)
    return _at(place)


def by_pattern(pattern: str) -> Column:
    """The cell under the first column whose name matches."""
    flags = F.transform("names", lambda x: x.rlike(pattern))
    return _at(F.array_position(flags, True))


def trajectory_csv(lines: DataFrame, every: int = 10, origin: tuple[float, float] = (45.0, 29.0)) -> DataFrame:
    """(file, no, t_s, lat, lon, alt_m): every tenth row and the last of trajectory tables.

    Positions are geodetic, or north, east, down in metres about an origin. Feet become metres. The unit of
    the timestamps (s, ms, us, ns) is told from the mean step of a file's rows, which lies between 0.1 ms and
    100 s.
    """
    n = lambda key: by_name(TRAJECTORY[key]).try_cast("double")
    rows = delimited(lines).select("file", "no", *[n(k).alias(k) for k in TRAJECTORY])
    ends = rows.groupBy("file").agg(F.max("no").alias("last"), F.min("no").alias("begin"), ((F.max("t") - F.min("t")) / F.greatest(F.count("t") - 1, F.lit(1))).alias("step"))
    unit = F.when(F.col("step") > 1e8, 1e-9).when(F.col("step") > 1e5, 1e-6).when(F.col("step") > 1e2, 1e-3).otherwise(1.0)
    kept = rows.join(ends, "file").where(((F.col("no") - F.col("begin")) % every == 0) | (F.col("no") == F.col("last")))
    lat = F.coalesce("lat", origin[0] + F.degrees(F.col("north") / 6371000.0))
    lon = F.coalesce("lon", origin[1] + F.degrees(F.col("east") / (6371000.0 * F.cos(F.radians(F.lit(origin[0]))))))
    return kept.select("file", "no", (F.col("t") * unit).alias("t_s"), lat.alias("lat"), lon.alias("lon"), F.coalesce("alt", F.col("alt_ft") * 0.3048, -F.col("down")).alias("alt_m"))


def flight_record_csv(lines: DataFrame) -> DataFrame:
    """(file, no, t_s, lat, lon, height_m, pitch): flight records; rows at (0, 0) go.

    Time starts at the first row of a recording where one is flagged, else at the file's first row.
    """
    n = lambda key: by_pattern(RECORD[key]).try_cast("double")
    on = F.lower(by_pattern(RECORD["recording"])).isin("1", "true", "yes")
    rows = delimited(lines).select("file", "no", *[n(k).alias(k) for k in RECORD if k != "recording"], F.coalesce(on, F.lit(False)).alias("on"))
    rows = rows.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT (abs(lat) < 1e-9 AND abs(lon) < 1e-9)")
    zero = rows.groupBy("file").agg(F.coalesce(F.min(F.when(F.col("on"), F.col("ms"))), F.min("ms")).alias("zero"))
    return rows.join(zero, "file").select("file", "no", ((F.col("ms") - F.col("zero")) / 1000).alias("t_s"), "lat", "lon", F.coalesce("height_m", F.col("height_ft") * 0.3048).alias("height_m"), "pitch")


def telemetry_json(texts: DataFrame, text: str = "value") -> DataFrame:
    """(file, no, frame_id, time_s, latitude, longitude, relative_altitude_m): waypoints of JSON documents.

    A document is an object with ``waypoints`` or the list itself. Whatever else it holds, such as a
    georeference of an earlier import, is left behind; what a waypoint lacks is null, its number is its place.
    """
    point = "struct<frame_id:bigint,time_s:double,latitude:double,longitude:double,relative_altitude_m:double>"
    whole = F.from_json(text, f"waypoints array<{point}>", {"mode": "PERMISSIVE"})["waypoints"]
    bare = F.from_json(text, f"array<{point}>", {"mode": "PERMISSIVE"})
    rows = texts.select("file", F.posexplode(F.when(F.ltrim(text).startswith("["), bare).otherwise(whole)).alias("no", "w")).where("w IS NOT NULL")
    return rows.select("file", "no", F.coalesce("w.frame_id", F.col("no").cast("bigint")).alias("frame_id"), "w.time_s", "w.latitude", "w.longitude", "w.relative_altitude_m")


def intrinsics(texts: DataFrame, text: str = "value") -> DataFrame:
    """(file, model, width, height, fx, fy, cx, cy, distortion) of camera files, one camera a file.

    Understood are lines of a camera list (id model width height parameters), matrices of YAML, XML or JSON
    files and plain fx, fy, cx, cy. The model is OPENCV where a distortion is not zero, else PINHOLE; a size
    that is not given is twice the centre.
    """
    number = r"-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"
    nums = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"({number})"), F.lit(1)), lambda x: x.try_cast("double"))
    line = F.regexp_extract(text, r"(?m)^\s*\d+\s+(SIMPLE_PINHOLE|PINHOLE|SIMPLE_RADIAL|RADIAL|OPENCV)\s+([^\n]*)$", 0)
    named = lambda key: F.nullif(F.regexp_extract(text, rf"(?i)[\"'<]?\b{key}\b[\"'>]?\s*[:=]?\s*({number})", 1), F.lit("")).try_cast("double")
    block = lambda key: F.regexp_extract(text, rf"(?is){key}.*?(?:data\"?\s*:?|<data>)\s*\[?([^\]<]*)", 1)
    kind = F.regexp_extract(line, r"\d+\s+([A-Z_]+)", 1)
    p = F.slice(nums(F.regexp_replace(line, r"^\s*\d+\s+[A-Z_]+", "")), 1, 20)
    one = kind.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")
    matrix, bent = nums(block("camera_?matrix")), nums(block("dist\\w*"))
    at = lambda a, k: F.try_element_at(a, F.lit(k))
    listed = F.length(line) > 0
    fx = F.coalesce(F.when(listed, at(p, 3)), F.when(F.size(matrix) >= 9, at(matrix, 1)), named("fx"))
    fy = F.coalesce(F.when(listed & one, at(p, 3)).when(listed, at(p, 4)), F.when(F.size(matrix) >= 9, at(matrix, 5)), named("fy"), fx)
    cx = F.coalesce(F.when(listed & one, at(p, 4)).when(listed, at(p, 5)), F.when(F.size(matrix) >= 9, at(matrix, 3)), named("cx"))
    cy = F.coalesce(F.when(listed & one, at(p, 5)).when(listed, at(p, 6)), F.when(F.size(matrix) >= 9, at(matrix, 6)), named("cy"))
    rest = F.when(listed & one, F.slice(p, 6, 8)).when(listed, F.slice(p, 7, 8)).otherwise(F.when(F.size(bent) > 0, bent).otherwise(F.array(*[F.coalesce(named(k), F.lit(0.0)) for k in ("k1", "k2", "p1", "p2")])))
    width = F.coalesce(F.when(listed, at(p, 1)), named("(?:image_)?width"), 2 * cx)
    height = F.coalesce(F.when(listed, at(p, 2)), named("(?:image_)?height"), 2 * cy)
    model = F.when(F.exists(rest, lambda x: F.abs(x) > 0), "OPENCV").otherwise("PINHOLE")
    return texts.select("file", model.alias("model"), width.alias("width"), height.alias("height"), fx.alias("fx"), fy.alias("fy"), cx.alias("cx"), cy.alias("cy"), rest.alias("distortion")).where("fx IS NOT NULL AND cx IS NOT NULL")


def third_is_altitude(fixes: DataFrame, third: str = "third") -> DataFrame:
    """(file, altitude): whether the third value of a file's GPS texts is a height and not a count of satellites.

    It is one where most of the texts are decimal; whole numbers of 0 to 40 beside a barometer are counts.
    """
    value = F.col(third).try_cast("double")
    decimal = F.avg(F.col(third).contains(".").cast("int")) > 0.5
    counts = F.bool_and(value.between(0, 40)) & F.bool_or(F.col("barometer").isNotNull())
    return fixes.where(F.col(third).isNotNull()).groupBy("file").agg((decimal | ~F.coalesce(counts, F.lit(False))).alias("altitude"))
