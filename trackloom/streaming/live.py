"""Streams of boxes: counts in event time with late rows, and a simple online tracker with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.functions import geometry as g
from trackloom.operators.nms import SIDES
from trackloom.operators.resolve import box_iou

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """``events`` as a stream, ``ts`` in UTC."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Rows and mean value of each type in tumbling or sliding windows; rows later than ``late`` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, pause: str, late: str = "2 hours") -> DataFrame:
    """Rows of each user's sessions, which end after a pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", pause).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def matched_stream(pred: DataFrame, truth: DataFrame, least: float = 0.5, late: int = 24) -> DataFrame:
    """(clip, frame, o, p, iou): truth and predicted boxes of a frame that overlap enough, as both come in; what has found no partner comes with a null.

    Event time counts a frame (from 0) as a second, from 1. State holds the rows of the last ``late`` frames of either side: a pair
    comes out when its second box is there, a lone box when the watermark has passed its frame, and a row that is further behind is dropped.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        sides = [F.col(c).alias(f"{name}_{c}") for c in ("clip", "frame", *SIDES)]
        return df.select(F.col("tid").alias(name), *sides, F.timestamp_seconds(F.col("frame") + 1).alias(f"{name}_at")).withWatermark(f"{name}_at", f"{late} seconds")

    iou = g.iou(g.box("o_"), g.box("p_"))
    together = F.expr("o_clip = p_clip AND o_frame = p_frame AND o_at = p_at")
    both = side(truth, "o").join(side(pred, "p"), together & (iou >= least), "full_outer")
    return both.select(F.coalesce("o_clip", "p_clip").alias("clip"), F.coalesce("o_frame", "p_frame").alias("frame"), "o", "p", F.when(F.col("o_clip").isNotNull() & F.col("p_clip").isNotNull(), iou).alias("iou"))


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that the stream has now, written to Parquet and read back. In complete mode the last result stands."""
    if mode == "complete":
        w = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint)
    else:
        w = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


TRACKED = "clip string, frame long, tid long, x1 double, y1 double, x2 double, y2 double, conf double"
STATE = "next_id long, ids array<long>, frames array<long>, boxes array<double>"


def online_tracks(boxes: DataFrame, least: float = 0.3, memory: int = 24) -> DataFrame:
    """Ids for boxes (clip, frame, box, conf) as they come, one state for each clip.

    A tracker of our own: a box continues the track whose last box it overlaps most, best pairs first; a
    track not seen for ``memory`` frames is forgotten. State holds the live tracks of a clip only.
    Rows of a micro-batch are taken in order of frames; rows older than the state start tracks of their own.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, ids, seen, last = 1, [], [], np.zeros((0, 4))
        if state.exists:
            next_id, i, f, b = state.get
            ids, seen, last = list(i), list(f), np.array(b, float).reshape(-1, 4)
        rows = pd.concat(list(chunks)).dropna(subset=["frame"]).sort_values(["frame", *SIDES])
        # Arrays by frame: cutting a table up and putting it together again for each frame costs more than tracking.
        frames, sides, given = rows["frame"].to_numpy(), rows[SIDES].to_numpy(float), np.zeros(len(rows), np.int64)
        edges = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1), len(rows)] if len(rows) else [0]
        for start, stop in zip(edges, edges[1:], strict=False):
            frame, b = int(frames[start]), sides[start:stop]
            live = [k for k, s in enumerate(seen) if frame - s <= memory]
            if len(live) < len(seen):
                ids, seen, last = [ids[k] for k in live], [seen[k] for k in live], last[live]
            m = box_iou(b, last).ravel()
            near = np.flatnonzero(m >= least)
            mine, taken = [0] * len(b), set()
            for p in near[np.argsort(-m[near], kind="stable")]:
                i, j = divmod(int(p), len(ids))
                if not mine[i] and j not in taken:
                    mine[i], seen[j], last[j] = ids[j], frame, b[i]
                    taken.add(j)
            new = [i for i, t in enumerate(mine) if not t]
            if new:
                fresh = list(range(next_id, next_id + len(new)))
                for i, t in zip(new, fresh, strict=True):
                    mine[i] = t
                ids, seen, last, next_id = [*ids, *fresh], [*seen, *[frame] * len(new)], np.vstack([last, b[new]]), next_id + len(new)
            given[start:stop] = mine
        state.update((next_id, [int(x) for x in ids], [int(x) for x in seen], [float(x) for x in last.ravel()]))
        yield rows.assign(clip=key[0], tid=given)[["clip", "frame", "tid", *SIDES, "conf"]]

    return boxes.select("clip", "frame", *SIDES, "conf").groupBy("clip").applyInPandasWithState(step, TRACKED, STATE, "append", GroupStateTimeout.NoTimeout)
