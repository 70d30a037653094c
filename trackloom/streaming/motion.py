"""An online tracker with motion and appearance: one state a clip, a map entry a track, a timer that forgets what has gone.

A tracker of our own, no copy of a published one: a constant-velocity Kalman filter over (centre, sides) says where a track
is by now, so a track that was hidden is looked for where it must have got to. Pairs are taken cheapest first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackloom.operators.nms import SIDES
from trackloom.operators.resolve import box_iou, look_cosine

TRACKED = "clip string, frame long, tid long, x1 double, y1 double, x2 double, y2 double, conf double"
TRACK = "frame long, mean array<double>, cov array<double>, look array<double>"
#: Fixed values of the guard: what is added to a covariance that can't be factored grows tenfold from JITTER, TRIES times at most.
JITTER, TRIES = 1e-6, 6
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Standard deviations as shares of a box's height: of a position and of a velocity.
POSITION, VELOCITY = 1 / 20, 1 / 160


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Inside, streams start with the state store that map state and timers need."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def factored(cov: np.ndarray) -> np.ndarray:
    """Cholesky factor; a matrix that has none gets a growing share of the unit matrix first."""
    for k in range(TRIES):
        try:
            return np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            cov = cov + JITTER * 10.0**k * np.eye(len(cov))
    return np.linalg.cholesky(cov)


class Filter:
    """A track's place (centre x, y, width, height), its velocity, and how sure they are."""

    def __init__(self, frame: int, mean: np.ndarray, cov: np.ndarray, look: Any = None):
        self.frame, self.mean, self.look = frame, mean, look
        self.spread = float(cov[0, 0]), float(cov[0, 4]), float(cov[4, 4])

    @property
    def cov(self) -> np.ndarray:
        """The whole matrix: all four places start alike, move alike and are seen alike, so one 2 x 2 matrix of place and velocity serves each of them."""
        p, q, r = self.spread
        return np.kron([[p, q], [q, r]], np.eye(4))

    @classmethod
    def of(cls, frame: int, box: np.ndarray, look: Any) -> Filter:
        seen = cls.seen(box)
        spread = np.r_[np.full(4, 2 * POSITION), np.full(4, 10 * VELOCITY)] * max(seen[3], 1.0)
        return cls(frame, np.r_[seen, np.zeros(4)], np.diag(spread**2), look)

    @staticmethod
    def seen(box: np.ndarray) -> np.ndarray:
        return np.array([(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1]])

    def at(self, frame: int) -> tuple[np.ndarray, tuple[float, float, float]]:
        """Mean, and variance of place, covariance, variance of velocity, at a later frame."""
        step, (p, q, r), size = frame - self.frame, self.spread, max(float(self.mean[3]), 1.0)
        mean = self.mean.copy()
        mean[:4] += step * self.mean[4:]
        return mean, (p + 2 * step * q + step * step * r + step * (POSITION * size) ** 2, q + step * r, r + step * (VELOCITY * size) ** 2)

    def box(self, frame: int) -> np.ndarray:
        return boxes_at([self], frame)[0]

    def update(self, frame: int, box: np.ndarray, look: Any) -> None:
        mean, (p, q, r) = self.at(frame)
        noise = (POSITION * max(float(mean[3]), 1.0)) ** 2
        place, speed = p / (p + noise), q / (p + noise)
        off = self.seen(box) - mean[:4]
        mean[:4] += place * off
        mean[4:] += speed * off
        self.mean, self.frame, self.spread = mean, frame, ((1 - place) * p, (1 - place) * q, r - speed * q)
        if look is not None:
            self.look = look if self.look is None else 0.9 * np.asarray(self.look, float) + 0.1 * np.asarray(look, float)

    def row(self) -> tuple:
        return int(self.frame), [float(x) for x in self.mean], [float(x) for x in self.cov.ravel()], None if self.look is None else [float(x) for x in self.look]


def boxes_at(tracks: list[Filter], frame: int) -> np.ndarray:
    """Where tracks are by a frame, a box a row."""
    means, steps = np.array([t.mean for t in tracks]), np.array([frame - t.frame for t in tracks])[:, None]
    place = means[:, :4] + steps * means[:, 4:]
    return np.hstack([place[:, :2] - place[:, 2:] / 2, place[:, :2] + place[:, 2:] / 2])


def assigned(tracks: dict[int, Filter], frame: int, boxes: np.ndarray, looks: list, least: float, least_look: float, weight: float) -> dict[int, int]:
    """{place of a box: track}. A pair must overlap by ``least`` where the track is by now, and look alike where both have a look; cheapest pairs first, ties by id and place."""
    if not tracks or not len(boxes):
        return {}
    ids = sorted(tracks)
    overlap = box_iou(boxes, boxes_at([tracks[t] for t in ids], frame))
    pairs = []
    for i, j in zip(*np.nonzero(overlap >= least), strict=True):
        a, b = looks[i], tracks[ids[j]].look
        alike = look_cosine(a, b)
        if a is None or b is None or alike >= least_look:
            pairs.append((round((1 - weight) * (1 - overlap[i, j]) + weight * (1 - alike), 9), ids[j], int(i)))
    out: dict[int, int] = {}
    taken = set()
    for _, t, i in sorted(pairs):
        if i not in out and t not in taken:
            out[i] = t
            taken.add(t)
    return out


class _Tracker(StatefulProcessor):
    def __init__(self, least: float, memory: int, least_look: float, weight: float):
        self.least, self.memory, self.least_look, self.weight = least, memory, least_look, weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "tid long", TRACK)
        self.clip = handle.getValueState("clip", "next_id long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        next_id, last = self.clip.get() if self.clip.exists() else (1, -1)
        held = {int(k[0]): Filter(int(v[0]), np.array(v[1]), np.array(v[2]).reshape(8, 8), v[3]) for k, v in self.tracks.iterator()}
        live = dict(held)
        rows = pd.concat(list(rows)).dropna(subset=["frame"]).sort_values(["frame", *SIDES, "conf"])
        # Arrays by frame: cutting a table up and putting it together again for each frame costs more than tracking.
        frames, sides, seen, given = rows["frame"].to_numpy(), rows[SIDES].to_numpy(float), rows["look"].tolist(), []
        edges = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1), len(rows)] if len(rows) else [0]
        for start, stop in zip(edges, edges[1:], strict=False):
            frame = int(frames[start])
            if frame <= last:  # its place in the order has passed
                given += [None] * (stop - start)
                continue
            live = {t: x for t, x in live.items() if frame - x.frame <= self.memory}
            boxes, looks = sides[start:stop], [None if x is None else np.asarray(x, float) for x in seen[start:stop]]
            found = assigned(live, frame, boxes, looks, self.least, self.least_look, self.weight)
            for i, box in enumerate(boxes):
                if i in found:
                    live[found[i]].update(frame, box, looks[i])
                else:
                    found[i], next_id = next_id, next_id + 1
                    live[found[i]] = Filter.of(frame, box, looks[i])
                given.append(found[i])
            last = frame
        for t in held.keys() - live.keys():
            self.tracks.removeKey((t,))
        for t, x in live.items():
            self.tracks.updateValue((t,), x.row())
        self.clip.update((int(next_id), int(last)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if live:
            self.handle.registerTimer((last + self.memory + 2) * 1000)
        yield rows.assign(clip=key[0], tid=pd.array(given, dtype="Int64"))[["clip", "frame", "tid", *SIDES, "conf"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No box for the length of the memory: all tracks of the clip are forgotten, its ids go on."""
        self.tracks.clear()
        return iter([])

    def close(self) -> None:
        pass


def motion_tracks(boxes: DataFrame, least: float = 0.3, memory: int = 24, late: int = 24, least_look: float = 0.5, weight: float = 0.3) -> DataFrame:
    """Ids for boxes (clip, frame, box, conf and perhaps look) as they come; state is kept by ``state_store``.

    A track unseen for ``memory`` frames is forgotten. Event time counts a frame (from 0) as a second, from 1 as Spark takes second 0 for late: rows ``late`` frames behind the latest frame of
    the stream are dropped, rows of frames that a clip has passed come out without an id. A clip's state holds its live tracks
    and ends by a timer when no box has come for the length of the memory.
    """
    look = F.col("look").cast("array<double>") if "look" in boxes.columns else F.lit(None).cast("array<double>")
    rows = boxes.select("clip", "frame", *SIDES, "conf", look.alias("look"), F.timestamp_seconds(F.col("frame") + 1).alias("at")).withWatermark("at", f"{late} seconds")
    return rows.groupBy("clip").transformWithStateInPandas(_Tracker(least, memory, least_look, weight), TRACKED, "append", "EventTime")
