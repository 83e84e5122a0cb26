"""Schemas that drift between files: fingerprints, migration steps, one consistent table.

Every line of a file is a JSON object under the names of the day. A registry of aliases says which raw
names stand for which canonical field and how a raw value becomes a canonical one. For each file the
operator derives its profile (which fields it has, under which raw name, of which JSON type), and from
that the schema fingerprint. Files of one writer with the same fingerprint in a row form a schema
version; where the fingerprint changes, explicit migration steps lead from the version before to the
new one: ``added`` (older rows get the default null), ``removed``, ``renamed`` and ``type_changed``
(values are cast). The steps are the report of changes; the readings take the rules of their file's
version, so a raw value passes rename, cast and default on its way into the one table.

Defined results: lines that are no JSON object, names outside the registry and JSON nulls carry no
field. Repeated lines of a file count once. A file's type of a field is that of most of its values, of
equally many the first of number, string, array. A raw name that carries two fields counts for both.
Malformed values (text in a numeric field, or the filler -1 written as a whole number where a decimal
is due) are null in the readings. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.session import cut_lineage

#: Canonical waypoint fields and the raw names that stand for them.
LINE_ALIASES = {
    "frame_id": ["frame_id", "frame", "frame_no", "FrameCnt"],
    "time_s": ["time_s", "t_sec", "elapsed_s", "flyTime", "time_ms"],
    "latitude": ["latitude", "lat", "gps_lat", "Latitude_deg", "osd.latitude", "lat_e7"],
    "longitude": ["longitude", "lon", "lng", "gps_lon", "Longitude_deg", "osd.longitude", "lon_e7"],
    "relative_altitude_m": ["relative_altitude_m", "rel_alt", "height_above_takeoff", "osd.height", "relHeightFt"],
    "absolute_altitude_m": ["absolute_altitude_m", "abs_alt", "alt_msl", "elevation_asl"],
    "gb_pitch": ["gb_pitch", "gimbal_pitch", "gimbalPitchDeg"],
    "gb_yaw": ["gb_yaw", "gimbal_yaw", "gimbal_heading"],
    "rtk_q": ["rtk_q", "rtk_flag", "fixQuality"],
}
#: Raw names that carry latitude and longitude together.
PAIRS = ["pos", "gps", "coordinates", "GPS_pair"]
HEADER_ALIASES = {
    "latlon_order": ["latlon_order", "coord_order", "gpsAxisOrder"],
    "altitude_reference": ["altitude_reference", "alt_ref", "vertical_datum"],
    "focal_length_35mm": ["focal_length_35mm", "focal35", "focalLen"],
}
#: Units of raw names that differ from the canonical field's.
FACTORS = {"time_ms": 0.001, "lat_e7": 1e-7, "lon_e7": 1e-7, "relHeightFt": 0.3048}


@dataclass(frozen=True)
class Registry:
    line: dict[str, list[str]]
    header: dict[str, list[str]]
    pairs: list[str]

    def carried(self, header: bool) -> dict[str, list[str]]:
        """Raw name to the canonical fields it carries."""
        out = {raw: [field] for field, raws in (self.header if header else self.line).items() for raw in raws}
        if not header:
            out |= {raw: ["latitude", "longitude"] for raw in self.pairs}
        return out


WAYPOINT_LOGS = Registry(LINE_ALIASES, HEADER_ALIASES, PAIRS)


def _lookup(key: Column, table: dict[str, list[str]]) -> Column:
    entries: list[Column] = []
    for raw, fields in table.items():
        entries += [F.lit(raw), F.array(*[F.lit(f) for f in fields])]
    return F.element_at(F.create_map(*entries), key)


def json_type(value: Column) -> Column:
    """number, string, array, boolean or object; null for JSON null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"), "number")
    )


def values(logs: DataFrame, registry: Registry = WAYPOINT_LOGS) -> DataFrame:
    """One row for each non-null value of a known raw name in the distinct lines.

    Columns: file_id, logger_id, survey_id, written_at, line_no, header, raw_name, kind, value (as text),
    whole (a whole number), fields.
    """
    spark = logs.sparkSession
    lines = (
        logs.where("file_id IS NOT NULL AND logger_id IS NOT NULL AND payload IS NOT NULL")
        .groupBy("file_id", "logger_id", (F.col("line_no") == 0).alias("header"), "payload")
        .agg(F.min("line_no").alias("line_no"), F.min("survey_id").alias("survey_id"), F.min("written_at").alias("written_at"))
        .withColumn("object", F.try_parse_json("payload"))
        .where("object IS NOT NULL")
        .drop("payload")
    )
    pairs = lines.lateralJoin(spark.tvf.variant_explode(F.col("object").outer()))
    known = F.when(F.col("header"), _lookup(F.col("key"), registry.carried(True))).otherwise(_lookup(F.col("key"), registry.carried(False)))
    return (
        pairs.where("key IS NOT NULL")
        .withColumn("fields", known)
        .where("fields IS NOT NULL")
        .withColumn("kind", json_type(F.col("value")))
        .where("kind IS NOT NULL")
        .select(
            "file_id", "logger_id", "survey_id", "written_at", "line_no", F.coalesce("header", F.lit(False)).alias("header"), F.col("key").alias("raw_name"), "kind",
            F.col("value").cast("string").alias("value"), F.schema_of_variant("value").isin("BIGINT", "INT", "SMALLINT", "TINYINT").alias("whole"), "fields",
        )
    )


def profiles(found: DataFrame) -> DataFrame:
    """(file_id, logger_id, written_at, field_name, raw_name, kind) for each field a file has."""
    by_name = (
        found.withColumn("field_name", F.explode("fields"))
        .groupBy("file_id", "logger_id", "written_at", "field_name", "raw_name", "kind")
        .agg(F.count("*").alias("n"))
    )
    rank = F.when(F.col("kind") == "number", 3).when(F.col("kind") == "string", 2).when(F.col("kind") == "array", 1).otherwise(0)
    return (
        by_name.groupBy("file_id", "logger_id", "written_at", "field_name")
        .agg(F.max(F.struct("n", rank.alias("rank"), "raw_name", "kind")).alias("top"))
        .select("file_id", "logger_id", "written_at", "field_name", F.col("top.raw_name").alias("raw_name"), F.col("top.kind").alias("kind"))
    )


def versions(logs: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each file: fingerprint, schema version in its logger, and the file before.

    Files without any known field have an empty schema. A logger's window holds a few numbers of each file.
    """
    files = logs.where("file_id IS NOT NULL AND logger_id IS NOT NULL").groupBy("file_id", "logger_id").agg(F.min("written_at").alias("written_at"))
    prints = schemas.groupBy("file_id", "logger_id").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("field_name", "raw_name", "kind")))).alias("fingerprint"))
    per_file = files.join(prints, ["file_id", "logger_id"], "left").fillna(0, "fingerprint")
    order = Window.partitionBy("logger_id").orderBy("written_at", "file_id")
    fresh = F.coalesce(F.lag("fingerprint").over(order) != F.col("fingerprint"), F.lit(True))
    return (
        per_file.withColumn("fresh", fresh)
        .withColumn("before_id", F.lag("file_id").over(order))
        .withColumn("version", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )


def all_steps(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """Migration steps into each schema version; those into a logger's first one add all its fields."""
    new = files.where("fresh")
    now = new.join(schemas.drop("written_at"), ["file_id", "logger_id"]).withColumn("side", F.lit("now"))
    was = new.join(schemas.drop("written_at").withColumnRenamed("file_id", "before_id"), ["before_id", "logger_id"]).withColumn("side", F.lit("was"))
    rule = F.struct("raw_name", "kind")
    both = now.select(*was.columns).unionByName(was).groupBy("file_id", "logger_id", "version", "before_id", "field_name")
    steps = both.agg(F.max(F.when(F.col("side") == "now", rule)).alias("now"), F.max(F.when(F.col("side") == "was", rule)).alias("was"))
    change = F.when(F.col("was").isNull(), F.array(F.lit("added"))).when(F.col("now").isNull(), F.array(F.lit("removed"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("now.raw_name") != F.col("was.raw_name"), F.lit("renamed")),
                F.when(F.col("now.kind") != F.col("was.kind"), F.lit("type_changed")),
            )
        )
    )
    return steps.select(
        "file_id", "logger_id", "version", "before_id", "field_name", F.explode(change).alias("change"), F.col("was.raw_name").alias("from_name"), F.col("now.raw_name").alias("to_name"), F.col("was.kind").alias("from_kind"), F.col("now.kind").alias("to_kind")
    )


def migration_steps(logs: DataFrame, registry: Registry = WAYPOINT_LOGS) -> DataFrame:
    """One row for each change between a file and the one of its logger before it.

    Columns: file_id, logger_id, version, field_name, change, from_name, to_name, from_kind, to_kind. Only
    the first file of a schema version has steps; the first version of a logger has none.
    """
    schemas = cut_lineage(profiles(values(logs, registry)))
    return all_steps(versions(logs, schemas), schemas).where("before_id IS NOT NULL").drop("before_id")


def version_rules(files: DataFrame, steps: DataFrame, registry: Registry) -> DataFrame:
    """(logger_id, version, field_name, rule, kind): the raw name and type each version reads a field from.

    The steps are chained: a field's rule is that of the latest step up to the version, and a removed
    field has none, which means the default null.
    """
    names = [*registry.line, *registry.header]
    known = files.select("logger_id", "version").distinct().withColumn("field_name", F.explode(F.array(*[F.lit(n) for n in names])))
    latest = steps.groupBy("logger_id", "version", "field_name").agg(F.max(F.struct("to_name", "to_kind")).alias("step"))
    order = Window.partitionBy("logger_id", "field_name").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    chained = known.join(latest, ["logger_id", "version", "field_name"], "left").withColumn("rule", F.last("step", ignorenulls=True).over(order))
    return chained.where("rule.to_name IS NOT NULL").select("logger_id", "version", "field_name", F.col("rule.to_name").alias("rule"), F.col("rule.to_kind").alias("kind"))


def unmapped_names(logs: DataFrame, registry: Registry = WAYPOINT_LOGS) -> DataFrame:
    """(file_id, header, raw_name, n): names outside the registry that carry a value, with their distinct lines.

    They are bookkeeping or a field's new name that the registry doesn't know yet; nothing vanishes unseen.
    """
    lines = logs.where("file_id IS NOT NULL AND payload IS NOT NULL").select("file_id", F.coalesce(F.col("line_no") == 0, F.lit(False)).alias("header"), "payload").distinct()
    lines = lines.withColumn("object", F.try_parse_json("payload")).where("object IS NOT NULL")
    pairs = lines.lateralJoin(logs.sparkSession.tvf.variant_explode(F.col("object").outer())).where("key IS NOT NULL")
    known = F.when(F.col("header"), F.col("key").isin(*registry.carried(True))).otherwise(F.col("key").isin(*registry.carried(False)))
    return pairs.where(~known & ~F.is_variant_null("value")).groupBy("file_id", "header", F.col("key").alias("raw_name")).agg(F.count("*").alias("n"))


def consistent_readings(logs: DataFrame, registry: Registry = WAYPOINT_LOGS) -> DataFrame:
    """All waypoint lines in one schema, whatever their file calls and writes their fields.

    Each file takes the chained rules of its schema version. A value comes from the rule's raw name, else
    from the alias that the registry names first; of several values under one name, the smallest.
    Coordinates of a pair follow the order the file's header names, lat_lon where it names none.
    """
    found = values(logs, registry)
    schemas = cut_lineage(profiles(found))  # a dozen rows a file; used four times
    files = versions(logs, schemas)
    rules = files.select("file_id", "logger_id", "version").join(version_rules(files, all_steps(files, schemas), registry), ["logger_id", "version"]).select("file_id", "field_name", "rule")
    order = (
        found.where("header AND array_contains(fields, 'latlon_order')")
        .groupBy("file_id")
        .agg(F.min("value").alias("order_text"))
        .select("file_id", (F.col("order_text").isin("1", "lon_lat") | F.col("order_text").rlike(r'^\[\s*"?lon')).alias("lon_first"))
    )
    lines = found.where("NOT header").withColumn("field_name", F.explode("fields")).join(rules, ["file_id", "field_name"], "left").join(order, "file_id", "left")
    pair = F.split(F.regexp_replace("value", r"[\[\]\s]", ""), ",")
    lon_first = F.coalesce("lon_first", F.lit(False))
    place = F.when((F.col("field_name") == "latitude") != lon_first, 1).otherwise(2)
    is_pair = F.col("raw_name").isin(*registry.pairs)
    text = F.when(is_pair, F.try_element_at(pair, place)).otherwise(F.col("value"))
    factor, rank = F.lit(1.0), F.lit(99)
    for raw, by in FACTORS.items():
        factor = F.when(F.col("raw_name") == raw, F.lit(by)).otherwise(factor)
    for raws in registry.line.values():
        for n, raw in enumerate(raws):
            rank = F.when(F.col("raw_name") == raw, n).otherwise(rank)
    number = text.try_cast("double")
    filler = (number == -1) & F.col("whole") & ~F.col("field_name").isin("frame_id", "time_s") | (F.col("field_name") == "rtk_q") & (number == -1)
    cast = lines.withColumn("number", F.when(~filler & ~F.isnan(number), number * factor))
    choice = F.struct(F.when(F.col("raw_name") == F.col("rule"), -1).otherwise(rank).alias("rank"), F.col("number"))
    wide = cast.where("number IS NOT NULL").groupBy("file_id", "logger_id", "survey_id", "written_at", "line_no").pivot("field_name", list(registry.line)).agg(F.min(choice).getField("number"))
    whole = {"frame_id": "bigint", "rtk_q": "int"}
    return wide.select("file_id", "logger_id", "survey_id", "written_at", "line_no", *[F.col(f).cast(whole.get(f, "double")).alias(f) for f in registry.line])
