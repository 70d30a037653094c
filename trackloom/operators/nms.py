"""Suppression of boxes that cover one another, frame by frame.

Frames are independent. Rows are dealt by frame and stream by in order (``frames``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.frames import Frame, by_frame
from trackloom.operators.resolve import box_iou

SIDES = ["x1", "y1", "x2", "y2"]


def hard(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Kept boxes by descending score (ties by place): each removes those it overlaps by more than the threshold."""
    order, overlap = np.lexsort((np.arange(len(scores)), -scores)), box_iou(boxes, boxes)
    kept, gone = [], np.zeros(len(scores), bool)
    for i in order:
        if not gone[i]:
            kept.append(int(i))
            gone |= overlap[i] > threshold
    return kept


def soft(boxes: np.ndarray, scores: np.ndarray, threshold: float, sigma: float = 0.5, least: float = 0.001) -> list[int]:
    """Kept boxes in order of choice: the score of those overlapped by more than the threshold shrinks by a Gaussian of the overlap."""
    overlap, s = box_iou(boxes, boxes), scores.astype(float).copy()
    alive, kept = np.ones(len(s), bool), []
    while alive.any():
        i = int(np.argmax(np.where(alive, s, -np.inf)))
        kept.append(i)
        s = np.where(overlap[i] > threshold, s * np.exp(-(overlap[i] ** 2) / max(sigma, 1e-9)), s)
        alive[i] = False
        alive &= s > least
    return kept


def suppress(df: DataFrame, threshold: float = 0.6, kind: str = "hard", sigma: float = 0.5, least: float = 0.001) -> DataFrame:
    """(clip, frame, det, box, conf, rank) of the boxes kept; df has clip, frame, det (place in the frame), box and conf.

    With a column ``scale`` boxes are known by scale and det, in that order, and both are returned.
    """
    cols = ["clip", "frame", *(["scale"] if "scale" in df.columns else []), "det", *SIDES, "conf"]

    def kept(f: Frame) -> Frame:
        b, s = np.stack([f[c] for c in SIDES], axis=1).astype(float), f["conf"].astype(float)
        at = hard(b, s, threshold) if kind == "hard" else soft(b, s, threshold, sigma, least)
        return {c: f[c][at] for c in cols} | {"rank": np.arange(len(at), dtype=np.int32)}

    types = {"clip": "string", "frame": "long", "scale": "int", "det": "long"}
    rows = df.select(*[F.col(c).cast(types.get(c, "double")).alias(c) for c in cols])
    return by_frame(rows, cols[2 : cols.index("det") + 1], kept, ", ".join(f"{c} {types.get(c, 'double')}" for c in cols) + ", rank int")


def union_of_scales(scales: list[DataFrame], threshold: float = 0.6) -> DataFrame:
    """Boxes of several detector scales in one set, with ``scale``; a single scale passes as it is."""
    every = None
    for i, s in enumerate(scales):
        s = s.withColumn("scale", F.lit(i))
        every = s if every is None else every.unionByName(s)
    return every if len(scales) == 1 else suppress(every, threshold)
