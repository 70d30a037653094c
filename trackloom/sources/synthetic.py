"""Seeded clips whose truth is known, with planted faults: hidden stretches, switched identities, false boxes.

All numbers come from hashes of (seed, clip, person, frame), so a clip is the same at any partitioning and of any number of clips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.ordered import VALUES

#: Which fault a person has, by its number modulo 3.
HIDDEN, SWITCHED, SHADOWED = 0, 1, 2
#: Frames of a hidden stretch, and every how manieth frame has a false box beside a person.
GAP, EVERY = 10, 20


def _rows(spark: SparkSession, clips: int, people: int, frames: int, seed: int) -> DataFrame:
    n = F.col("id")
    rows = spark.range(clips * people * frames).select(
        F.concat(F.lit("g"), F.floor(n / (people * frames))).alias("clip"), (F.floor(n / frames) % people).alias("person"), (n % frames).alias("frame")
    )
    noise = lambda salt, *of: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *of), F.lit(1 << 40)) / float(1 << 40))
    step = noise(1, "clip", "person") * 0.6 - 0.3
    x, y = 200.0 * F.col("person") + step * F.col("frame"), F.lit(50.0) + 20 * noise(2, "clip", "person")
    at = {f"_{k}": noise(k, "clip", "person", "frame") for k in range(3, 7)}
    return rows.withColumns({"x": x, "y": y, **at})


def _boxes(tid: Column, x: Column, y: Column, conf: Column) -> list[Column]:
    return [F.col("clip"), F.col("frame"), tid.cast("long").alias("tid"), *[c.alias(n) for c, n in zip((x, y, x + 40, y + 80, conf), VALUES, strict=True)]]


def truth(spark: SparkSession, clips: int = 2, people: int = 6, frames: int = 120, seed: int = 1) -> DataFrame:
    """(clip, frame, tid, box, conf) of every person in every frame."""
    return _rows(spark, clips, people, frames, seed).select(*_boxes(F.col("person") + 1, F.col("x"), F.col("y"), F.lit(1.0)))


def detections(spark: SparkSession, clips: int = 2, people: int = 6, frames: int = 120, seed: int = 1) -> DataFrame:
    """What a detector and tracker might make of ``truth``: boxes a pixel off at most, and the planted faults.

    A third of the people are hidden for ``GAP`` frames from frame frames // 3 on, a third have another id from frame frames // 2
    on, and a third have a false box of its own id above them every ``EVERY`` frames.
    """
    r = _rows(spark, clips, people, frames, seed)
    kind = F.col("person") % 3
    hidden = (kind == HIDDEN) & F.col("frame").between(frames // 3, frames // 3 + GAP - 1)
    tid = F.col("person") + 1 + F.when((kind == SWITCHED) & (F.col("frame") >= frames // 2), 1000).otherwise(0)
    conf = 0.8 + 0.2 * F.col("_5")
    seen = r.where(~hidden).select(*_boxes(tid, F.col("x") + 2 * F.col("_3") - 1, F.col("y") + 2 * F.col("_4") - 1, conf))
    false = r.where((kind == SHADOWED) & (F.col("frame") % EVERY == 0))
    return seen.unionByName(false.select(*_boxes(10_000 + F.col("person") * frames + F.col("frame"), F.col("x"), F.col("y") + 500 + 9 * F.col("_6"), conf)))


def planted(people: int = 6, frames: int = 120) -> dict[str, int]:
    """Faults of each clip: misses, switches, false_positives."""
    of = lambda k: len(range(k, people, 3))
    return {"misses": of(HIDDEN) * GAP, "switches": of(SWITCHED), "false_positives": of(SHADOWED) * len(range(0, frames, EVERY))}
