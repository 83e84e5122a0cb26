"""Event-time windows for streams and tables, and the way to run a stream over a folder to its end."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events folder as a stream; event time as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(schema)
    files = source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums of each type and window; ``late`` sets the watermark of a stream."""
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, every: str, late: str | None = None) -> DataFrame:
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy(F.window("ts", width, every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each user, closed by a gap."""
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(events: DataFrame, late: str) -> DataFrame:
    """Events without repeats of their id inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what its folder holds now, as a table in the shared folder.

    Batches are appended (append mode) or replace each other (complete mode); the table and the query's
    own checkpoint lie in the folder ``spark.checkpoint.dir`` names, so any executor can read them.
    """
    spark = stream.sparkSession
    base = shared_folder(spark)
    place = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    written = []

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure writes to its own folder again
        name = "all" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{place}/out/{name}")
        written.append(name)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{place}/out")
