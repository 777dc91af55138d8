"""Windowed aggregation of an event stream, and its run over stored files until they are used up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; windows close once the watermark has passed them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.to_date(F.col("window.start")).alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than gap apart; a session closes once the watermark has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n", "most")


def enriched(events: DataFrame, static: DataFrame, key: str, group: str, late: str = "1 hour") -> DataFrame:
    """Daily counts by a column of a static table that the stream is joined with."""
    timed = events.join(static, key).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", "1 day"), group).agg(F.count("*").alias("n"))
    return g.select(F.to_date(F.col("window.start")).alias("day"), group, "n")


def run_stored(spark: SparkSession, path: str, schema, build=tumbling) -> DataFrame:
    """Streams the files under path through build into a table in the shared folder, then reads it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    out = f"{base.rstrip('/')}/terralith/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).parquet(path)
    q = build(events).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def run_in_turn(spark: SparkSession, batches: list[DataFrame], build=tumbling) -> DataFrame:
    """Feeds batches of events one after the other to a stream that is stopped and resumed between them: its watermark
    and windows outlive it, and rows of windows that have closed are dropped."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    out = f"{base.rstrip('/')}/terralith/stream-{uuid.uuid4().hex}"
    for batch in batches:
        batch.write.mode("append").parquet(f"{out}/in")
        events = spark.readStream.schema(batch.schema).parquet(f"{out}/in")
        q = build(events).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
