"""Pairs of tracks that might be one: range joins over endpoints, bucketed so that no cross product is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import ordered
from trackloom.sources.store import stored


def gap_pairs(ends: DataFrame, low: int | Column, high: int | Column, ids: str = "tid") -> DataFrame:
    """Ordered pairs of a clip with ``low <= b.f0 - a.f1 <= high``, all columns prefixed a_ and b_. Bounds may be Columns over ``clip``.

    Heads are bucketed by frame in widths of ``high``; a tail looks into the two buckets that its
    range can touch, so the join is an equality on clip and bucket.
    """
    # Both sides are the same rows, one for each track: worked out once.
    bounded = stored(ends.withColumns({"_low": F.lit(low), "_high": F.lit(high)}), "pair-ends")
    a = bounded.select([F.col(c).alias(f"a_{c}") for c in bounded.columns])
    b = bounded.select([F.col(c).alias(f"b_{c}") for c in bounded.columns])
    a = a.withColumn("_k", F.explode(F.sequence(F.floor((F.col("a_f1") + F.col("a__low")) / F.col("a__high")), F.floor((F.col("a_f1") + F.col("a__high")) / F.col("a__high")))))
    b = b.withColumn("_k", F.floor(F.col("b_f0") / F.col("b__high"))).drop("b__low", "b__high")
    inside = (F.col("b_f0") - F.col("a_f1")).between(F.col("a__low"), F.col("a__high"))
    p = a.join(b, (F.col("a_clip") == F.col("b_clip")) & (a["_k"] == b["_k"]) & inside & (F.col(f"a_{ids}") != F.col(f"b_{ids}")))
    return p.drop("_k", "a__low", "a__high").withColumn("gap", F.col("b_f0") - F.col("a_f1"))


def merge_candidates(ends: DataFrame, fits: DataFrame, max_gap: int = 48, iou: float = 0.10, ids: str = "tid") -> DataFrame:
    """Pairs whose tail, drawn on to the other's first frame, meets its head: gap, iou, score = iou + 0.5."""
    p = gap_pairs(ends.join(fits, ["clip", ids]), 1, max_gap, ids)
    target = g.Box(*[F.col(f"a_s_{c}") * F.col("b_f0") + F.col(f"a_i_{c}") for c in g.BOX])
    p = p.withColumn("iou", g.iou(target, g.field_box(F.col("b_head")))).where(F.col("iou") >= iou)
    return p.withColumn("score", F.col("iou") + 0.5)


def with_look(pairs: DataFrame, a: Column, b: Column, least: float) -> DataFrame:
    """Pairs (iou, ...) with ``look``, the cosine of appearance (1 where one side has none; to six places at least ``least``), and score = iou + look / 2."""
    p = pairs.withColumn("look", F.coalesce(g.cosine(a, b), F.lit(1.0))).where(F.round("look", 6) >= least)
    return p.withColumn("score", F.col("iou") + 0.5 * F.col("look"))


def long_gap_candidates(ends: DataFrame, max_gap: int = 48, pose_max_gap: int = 120, max_distance: float = 150.0, ids: str = "tid") -> DataFrame:
    """Pairs further apart in time, by the distance between last and first centre."""
    p = gap_pairs(ends, max_gap + 1, pose_max_gap, ids)
    d = g.distance(g.centre(g.field_box(F.col("a_tail"))), g.centre(g.field_box(F.col("b_head"))))
    return p.withColumn("dist", d).where(F.col("dist") <= max_distance)


def stitch_candidates(ends: DataFrame, max_gap: int | Column = 400, max_jump: float | Column = 2000.0, max_ratio: float | Column = 4.0, cap: float = 200.0, ids: str = "tid") -> DataFrame:
    """Every tail and later head within ``max_gap`` empty frames, with position error and size ratios and whether both pass."""
    p = gap_pairs(ends.withColumns({"_jump": F.lit(max_jump), "_ratio": F.lit(max_ratio)}), 1, max_gap + 1, ids).withColumn("gap", F.col("gap") - 1)
    steps = F.col("gap") + 1
    dx, dy = g.capped(F.col("a_vx") * steps, F.col("a_vy") * steps, cap)
    tail, head = g.field_box(F.col("a_tail")), g.field_box(F.col("b_head"))
    cx, cy = g.centre(tail)
    p = p.withColumn("px", cx + dx).withColumn("py", cy + dy)
    hx, hy = g.centre(head)
    p = p.withColumn("pos_diff", g.distance((F.col("px"), F.col("py")), (hx, hy)))
    p = p.withColumn("w_ratio", g.side_ratio(g.width(tail), g.width(head))).withColumn("h_ratio", g.side_ratio(g.height(tail), g.height(head)))
    most = F.col("a__ratio")
    p = p.withColumn("size_ok", (F.col("w_ratio") <= most) & (F.col("h_ratio") <= most)).withColumn("pos_ok", F.col("pos_diff") <= F.col("a__jump"))
    return p.drop("a__jump", "a__ratio", "b__jump", "b__ratio")


#: Frames of a stretch in which thin tracks are drawn to find what shares a frame.
STRETCH = 64


def _boxes_of_frames(df: DataFrame, ids: str, thin: bool) -> DataFrame:
    """(clip, frame, boxes): the boxes of each frame. Of thin tracks the rows with their successors are dealt to stretches of frames and lines are drawn there."""
    keys = ["clip", "frame"]
    if thin:
        df = ordered.stretches(df, ("clip", ids), STRETCH).repartition("clip", "stretch")
        df, keys = ordered.drawn(df, ("clip", ids, "stretch"), STRETCH), ["clip", "stretch", "frame"]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(ids, *g.BOX)).alias("boxes"))


def _common_frames(df: DataFrame, ids: str, thin: bool = False) -> DataFrame:
    """Unordered pairs that share frames: how many, and the mean and largest overlap.

    Boxes are grouped by clip and frame and paired there, so the size follows the boxes of a frame; sums combine on the map side.
    """
    f = _boxes_of_frames(df, ids, thin).where(F.size("boxes") > 1)
    p = f.select("clip", "boxes", F.explode("boxes").alias("a")).select("clip", "a", F.explode("boxes").alias("b")).where(F.col(f"a.{ids}") < F.col(f"b.{ids}"))
    p = p.select("clip", F.col(f"a.{ids}").alias(f"a_{ids}"), F.col(f"b.{ids}").alias(f"b_{ids}"), g.iou(g.field_box(F.col("a")), g.field_box(F.col("b"))).alias("iou"))
    return p.groupBy("clip", f"a_{ids}", f"b_{ids}").agg(F.count("*").alias("common"), F.avg("iou").alias("mean_iou"), F.max("iou").alias("_most"))


def overlap_pairs(df: DataFrame, iou: float | Column = 0.7, min_frames: int | Column = 5, ids: str = "tid") -> DataFrame:
    """Unordered pairs that share frames: common frames and mean overlap, at least the bounds."""
    return _common_frames(df, ids).where((F.col("common") >= min_frames) & (F.col("mean_iou") >= iou)).drop("_most")


def touching_pairs(df: DataFrame, iou: float | Column = 0.7, min_frames: int | Column = 5, ids: str = "tid", thin: bool = False) -> DataFrame:
    """Unordered pairs that touch in some frame; ``mean_iou`` is null where ``overlap_pairs`` would leave the pair out."""
    enough = (F.col("common") >= min_frames) & (F.col("mean_iou") >= iou)
    return _common_frames(df, ids, thin).where("_most > 0").select("clip", f"a_{ids}", f"b_{ids}", F.when(enough, F.col("mean_iou")).alias("mean_iou"))
