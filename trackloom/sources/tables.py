"""Readers of the driver's Parquet tables and the detections derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the long detection table, in order.
DETECTION_COLUMNS = ["clip", "frame", "tid", "x1", "y1", "x2", "y2", "conf"]
IDS_PER_CLIP = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with track ids from ``events``: a row for each event, repeats of a frame included."""
    e = table(spark, sf_dir, "events").where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    slot = F.col("user_id") % IDS_PER_CLIP
    cx = 100 + slot * 12 + (F.col("event_id") * 13) % 21
    cy = 80 + slot * 6 + (F.col("event_id") * 17) % 15
    w = 20 + F.col("event_id") % 30
    h = 40 + F.col("event_id") % 50
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - F.lit(473352)  # hours from 1970 to 2024
    return e.select(
        "event_id",
        F.concat(F.lit("c"), F.floor(F.col("user_id") / IDS_PER_CLIP).cast("string")).alias("clip"),
        hour.cast("long").alias("frame"),
        F.col("user_id").cast("long").alias("tid"),
        (cx - w / 2).cast("double").alias("x1"),
        (cy - h / 2).cast("double").alias("y1"),
        (cx + w / 2).cast("double").alias("x2"),
        (cy + h / 2).cast("double").alias("y2"),
        ((300 + (F.col("event_id") * 7919) % 700) / 1000.0).cast("double").alias("conf"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each (clip, tid, frame): the most confident, then the earliest event.

    ``max_by`` over a struct combines on the map side, so a hot key costs a row a task.
    """
    raw = raw_detections(spark, sf_dir)
    best = F.max_by(F.struct("x1", "y1", "x2", "y2", "conf"), F.struct("conf", -F.col("event_id")))
    return raw.groupBy("clip", "frame", "tid").agg(best.alias("b")).select("clip", "frame", "tid", "b.*")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame) for every clip and hour up to the last one of the table, boxes or none."""
    raw = raw_detections(spark, sf_dir)
    last = F.broadcast(raw.agg(F.max("frame").alias("last")))  # one row
    return raw.select("clip").distinct().crossJoin(last).select("clip", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
