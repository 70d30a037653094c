"""What a run has done: a record for each clip and each kept table of the chain, appended to those of earlier runs."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.plans import pipeline

RECORDS = "run string, stage string, clip string, tracks long, boxes long, seconds double, boxes_per_second double, knobs string"


def records(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RECORDS).parquet(f"{root}/records")


def recorded_tracks(df: DataFrame, cfg: pipeline.Config, root: str) -> DataFrame:
    """``build_tracks`` with a record of each kept table: tracks and boxes of every clip, wall time of the stage, knobs.

    Counts are taken from the tables as they are kept, of which only two columns are read; seconds are those of the whole stage, over all clips.
    """
    run, knobs = uuid.uuid4().hex, json.dumps(asdict(cfg), sort_keys=True)

    def seen(stage: str, d: DataFrame, seconds: float) -> None:
        of = d.groupBy("clip").agg(F.countDistinct("tid").alias("tracks"), F.count("*").alias("boxes"))
        total = F.lit(float(d.count()) / max(seconds, 1e-9))
        row = of.select(F.lit(run).alias("run"), F.lit(stage).alias("stage"), "clip", "tracks", "boxes", F.lit(seconds).alias("seconds"), total.alias("boxes_per_second"), F.lit(knobs).alias("knobs"))
        row.coalesce(1).write.mode("append").parquet(f"{root}/records")

    return pipeline.build_tracks(df, cfg, seen)
