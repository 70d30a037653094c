"""Differences between two sets of boxes or tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators.frames import Frame, by_frame
from trackloom.operators.resolve import box_iou

KEY = ("clip", "frame", "tid")


def by_position(df: DataFrame) -> DataFrame:
    """Adds ``pos``: place of a box in its frame, by id."""
    from pyspark.sql import Window

    return df.withColumn("pos", F.row_number().over(Window.partitionBy("clip", "frame").orderBy("tid")) - 1)


def _sides(a: DataFrame, b: DataFrame, key: tuple[str, ...], values: list[str]) -> DataFrame:
    x = a.select(*key, F.lit(True).alias("in_a"), *[F.col(c).alias(f"a_{c}") for c in values])
    y = b.select(*key, F.lit(True).alias("in_b"), *[F.col(c).alias(f"b_{c}") for c in values])
    return x.join(y, list(key), "full")


def largest_box_error():
    return F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in g.BOX])


def frame_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each frame: boxes on either side, largest box and confidence error and differing ids of boxes at the same place."""
    j = _sides(by_position(a), by_position(b), ("clip", "frame", "pos"), [*g.BOX, "conf", "tid"])
    return j.groupBy("clip", "frame").agg(
        F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.max(largest_box_error()).alias("box_error"), F.max(F.abs(F.col("a_conf") - F.col("b_conf"))).alias("conf_error"),
        F.count_if(F.col("a_tid") != F.col("b_tid")).alias("id_mismatches"),
    )


def track_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each track of either side: rows only in a, only in b, and the largest box error of common frames."""
    j = _sides(a, b, KEY, list(g.BOX))
    return j.groupBy("clip", "tid").agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.max(largest_box_error()).alias("box_error"))


def missing_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of one side only: (clip, tid, side)."""
    x, y = a.select("clip", "tid").distinct(), b.select("clip", "tid").distinct()
    return x.subtract(y).withColumn("side", F.lit("a")).unionByName(y.subtract(x).withColumn("side", F.lit("b")))


def matched_diff(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """As ``frame_diff`` for boxes in any order: by falling confidence each box of ``a`` takes its best free box of ``b``."""
    cols = ["clip", "frame", "tid", *g.BOX, "conf"]
    # Boxes of a come first, by falling confidence, those of b by id.
    rows = a.select(*cols, F.lit(0).alias("side"), (-F.col("conf")).alias("place")).unionByName(b.select(*cols, F.lit(1).alias("side"), F.lit(0.0).alias("place")))

    def compared(f: Frame) -> Frame:
        n = int((f["side"] == 0).sum())
        box = np.stack([f[c] for c in g.BOX], axis=1).astype(float)
        m, i, j = box_iou(box[:n], box[n:]), [], []
        for k in range(n):
            if m.shape[1] and m[k].max() >= least:
                i.append(k)
                j.append(n + int(np.argmax(m[k])))
                m[:, j[-1] - n] = -1
        worst = lambda x: np.array([np.abs(x[i] - x[j]).max() if i else np.nan])
        counts = {"n_a": n, "n_b": len(box) - n, "matched": len(i), "id_mismatches": int((f["tid"][i] != f["tid"][j]).sum())}
        return {"clip": f["clip"][:1], "frame": f["frame"][:1], "box_error": worst(box), "conf_error": worst(f["conf"])} | {k: np.array([v]) for k, v in counts.items()}

    return by_frame(rows, ["side", "place", "tid"], compared, "clip string, frame long, n_a long, n_b long, matched long, box_error double, conf_error double, id_mismatches long")
