"""Operators along the frames of a track or clip: splitting, filling, fits, densities, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.functions import signal

TRACK = ("clip", "tid")
PIECE = ("clip", "tid", "piece")
VALUES = ("x1", "y1", "x2", "y2", "conf")


def split_on_gap(df: DataFrame, max_gap: int = 12) -> DataFrame:
    """``piece`` counts up where a track pauses for more than ``max_gap`` frames. (tid, piece) can't clash with another id."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    far = F.col("frame") - F.lag("frame").over(w) > max_gap
    return df.withColumn("_new", F.when(far, 1).otherwise(0)).withColumn("piece", F.sum("_new").over(w)).drop("_new")


def piece_id(tid: str = "tid", piece: str = "piece"):
    """One id for a piece, of the sign of its track's; piece 0 keeps an id that is its track's times a million."""
    return F.col(tid) * 1_000_000 + F.col(piece)


def _followed(df: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Rows with the frame and values of the next one of their group (_f, _x1, ...)."""
    w = Window.partitionBy(*group).orderBy("frame")
    return df.select(*group, "frame", *VALUES, F.lead("frame").over(w).alias("_f"), *[F.lead(c).over(w).alias(f"_{c}") for c in VALUES])


def _lines(r: DataFrame, group: tuple[str, ...], first: Column, last: Column) -> DataFrame:
    """Rows at the frames ``first`` to ``last`` on the way to the next row."""
    r = r.withColumn("_at", F.explode(F.sequence(first, last)))
    t = (F.col("_at") - F.col("frame")) / (F.col("_f") - F.col("frame"))
    line = lambda c: F.when(F.col("_at") == F.col("frame"), F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * t)
    return r.select(*group, F.col("_at").alias("frame"), *[line(c).alias(c) for c in VALUES], (F.col("_at") == F.col("frame")).alias("detected"))


def fill_gaps(df: DataFrame, group: tuple[str, ...] = PIECE) -> DataFrame:
    """Missing frames inside a group, by straight lines between the rows around them."""
    return _lines(_followed(df, group), group, F.col("frame"), F.coalesce(F.col("_f") - 1, F.col("frame")))


def stretches(df: DataFrame, group: tuple[str, ...], width: int) -> DataFrame:
    """Rows with their successors, once for each stretch of ``width`` frames on the way there."""
    at = lambda f: F.floor(f / width)
    return _followed(df, group).withColumn("stretch", F.explode(F.sequence(at(F.col("frame")), at(F.coalesce(F.col("_f") - 1, F.col("frame"))))))


def drawn(r: DataFrame, group: tuple[str, ...], width: int) -> DataFrame:
    """The frames of ``stretches``, each in its own one."""
    first = F.greatest(F.col("frame"), F.col("stretch") * width)
    return _lines(r, group, first, F.least(F.coalesce(F.col("_f") - 1, F.col("frame")), F.col("stretch") * width + width - 1))


def endpoints(df: DataFrame, group: tuple[str, ...] = TRACK, window: int = 5) -> DataFrame:
    """A row for each track: n, f0, f1, head, tail (box and conf), velocity of the tail (vx, vy: medians of its last ``window`` rows).

    One shuffle and one look at the rows: velocities come from the same order as the numbers of the last rows.
    """
    b = F.struct(*VALUES)
    last = Window.partitionBy(*group).orderBy(F.col("frame").desc())
    r = df.select(*group, "frame", *VALUES, *[c.alias(n) for c, n in zip(g.centre(g.box()), ("_cx", "_cy"), strict=True)])
    r = r.select("*", F.row_number().over(last).alias("_r"), *[F.lead(c).over(last).alias(f"_p{c}") for c in ("frame", "_cx", "_cy")])
    step = F.greatest(F.col("frame") - F.col("_pframe"), F.lit(1))
    r = r.withColumns({f"_v{x}": F.when(F.col("_r") < window, (F.col(f"_c{x}") - F.col(f"_p_c{x}")) / step) for x in "xy"})
    speed = [F.coalesce(F.percentile(f"_v{x}", F.lit(0.5)), F.lit(0.0)).alias(f"v{x}") for x in "xy"]
    return r.groupBy(*group).agg(F.count("*").alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min_by(b, "frame").alias("head"), F.max_by(b, "frame").alias("tail"), *speed)


def tail_fit(df: DataFrame, group: tuple[str, ...] = TRACK, rows: int = 3, head: bool = False) -> DataFrame:
    """Straight lines (slope s_, intercept i_ for each side) through the last rows of a track, or its first ones; one row gives slope 0."""
    last = Window.partitionBy(*group).orderBy(F.col("frame") if head else F.col("frame").desc())
    r = df.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= rows)
    fits = []
    for c in g.BOX:
        one = F.count("*") < 2
        fits += [F.when(one, 0.0).otherwise(F.regr_slope(c, "frame")).alias(f"s_{c}"), F.when(one, F.max(c)).otherwise(F.regr_intercept(c, "frame")).alias(f"i_{c}")]
    return r.groupBy(*group).agg(*fits)


def extrapolated(frame, prefix: str = "") -> g.Box:
    """The box that ``tail_fit`` columns predict at a frame."""
    return g.Box(*[F.col(f"{prefix}s_{c}") * frame + F.col(f"{prefix}i_{c}") for c in g.BOX])


def density(df: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes in every frame of the ``frames`` dimension, 0 where there are none."""
    n = df.groupBy("clip", "frame").agg(F.count("*").alias("n"))
    return frames.select("clip", "frame").join(n, ["clip", "frame"], "left").select("clip", "frame", F.coalesce("n", F.lit(0)).alias("n"))


def running_median(dens: DataFrame, window: int = 30) -> DataFrame:
    """Median of counts over ``window // 2`` frames on either side, cut at the ends of the clip."""
    half = max(1, window // 2)
    w = Window.partitionBy("clip").orderBy("frame").rowsBetween(-half, half)
    return dens.withColumn("med", F.percentile("n", F.lit(0.5)).over(w))


def suspicious_frames(dens: DataFrame, window: int = 30, drop: int = 1, stride: int = 5) -> DataFrame:
    """Frames with fewer boxes than usual, and every ``stride``-th one."""
    m = running_median(dens, window)
    return m.where((F.col("n") <= F.col("med") - drop) | (F.col("frame") % stride == 0))


def dense_window(dens: DataFrame, window: int) -> DataFrame:
    """(clip, start, boxes) of the fullest stretch of ``window`` frames, the first on a tie; a shorter clip is taken whole."""
    w = Window.partitionBy("clip").orderBy("frame").rowsBetween(0, window - 1)
    last = dens.groupBy("clip").agg(F.max("frame").alias("last"), F.min("frame").alias("first"))
    s = dens.withColumn("total", F.sum("n").over(w)).join(last, "clip")
    s = s.where((F.col("frame") + window - 1 <= F.col("last")) | (F.col("frame") == F.col("first")))
    return s.groupBy("clip").agg(F.max_by(F.struct(F.col("frame").alias("start"), F.col("total").alias("boxes")), F.struct("total", -F.col("frame"))).alias("b")).select("clip", "b.start", "b.boxes")


def as_arrays(df: DataFrame, group: tuple[str, ...] = TRACK, *more: Column) -> DataFrame:
    """A row for each track with its rows in order of frames, as ``rows``, and ``more`` aggregates."""
    cols = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("frame", *[c for c in cols if c != "frame"]))).alias("rows"), *more)


def by_frames(df: DataFrame, frames: DataFrame, order: str = "frame") -> DataFrame:
    """(clip, frame, boxes): the boxes of every frame of the ``frames`` dimension by id, empty where there are none; of repeats the first in ``order``."""
    one = df.groupBy("clip", "frame", "tid").agg(F.min_by(F.struct(*VALUES), order).alias("b"))
    held = one.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("tid", "b.*"))).alias("boxes"))
    none = F.array().cast(held.schema["boxes"].dataType)
    return frames.select("clip", "frame").join(held, ["clip", "frame"], "left").select("clip", "frame", F.coalesce("boxes", none).alias("boxes"))


def from_tracker(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes out of a tracker's output (clip, frame, found: array of [x1, y1, x2, y2, id, conf]): a row for each, confidence 1 where it is left out, a row without id for an empty frame."""
    v = lambda i: F.get("_v", F.lit(i)).cast("double")
    each = rows.select("clip", "frame", F.explode("found").alias("_v")).where(F.size("_v") >= 5)
    each = each.select("clip", "frame", v(4).cast("long").alias("tid"), *[v(i).alias(c) for i, c in enumerate(g.BOX)], F.coalesce(v(5), F.lit(1.0)).alias("conf"))
    return frames.select("clip", "frame").join(each, ["clip", "frame"], "left")


def _with_boxes(tracks: DataFrame, group: tuple[str, ...], boxes: list) -> DataFrame:
    """Rows again, boxes replaced by the arrays of x1, y1, x2, y2."""
    t = tracks.select(*group, "rows", *[b.alias(f"_{c}") for b, c in zip(boxes, g.BOX, strict=True)])
    t = t.select(*group, F.posexplode("rows").alias("_i", "_row"), *[f"_{c}" for c in g.BOX])
    names = [f for f in tracks.schema["rows"].dataType.elementType.fieldNames() if f not in g.BOX]
    return t.select(*group, *[F.col("_row")[f].alias(f) for f in names], *[F.get(f"_{c}", F.col("_i")).alias(c) for c in g.BOX])


def smooth_boxes(df: DataFrame, window: int = 11, sigma: float = 3.0, group: tuple[str, ...] = TRACK) -> DataFrame:
    """Median and Gaussian filter of every side in row order."""
    t = as_arrays(df, group)
    return _with_boxes(t, group, [signal.smooth(F.col(f"rows.{c}"), window, sigma) for c in g.BOX])


def _parts(tracks: DataFrame):
    f = lambda fn: F.transform("rows", fn)
    cx, cy = f(lambda r: (r["x1"] + r["x2"]) / 2), f(lambda r: (r["y1"] + r["y2"]) / 2)
    return cx, cy, f(lambda r: r["x2"] - r["x1"]), f(lambda r: r["y2"] - r["y1"])


def _sides(cx, cy, w, h) -> list:
    return [F.zip_with(cx, w, lambda a, b: a - b / 2), F.zip_with(cy, h, lambda a, b: a - b / 2), F.zip_with(cx, w, lambda a, b: a + b / 2), F.zip_with(cy, h, lambda a, b: a + b / 2)]


def smooth_centres(df: DataFrame, window: int = 21, group: tuple[str, ...] = TRACK) -> DataFrame:
    """Running median of the centres; sizes stay."""
    t = as_arrays(df, group)
    cx, cy, w, h = _parts(t)
    t = t.select("*", signal.median_edge(cx, window).alias("_cx"), signal.median_edge(cy, window).alias("_cy"))
    return _with_boxes(t, group, _sides(F.col("_cx"), F.col("_cy"), w, h))


def _sized(df: DataFrame, cv_threshold, window, group: tuple[str, ...]) -> tuple[DataFrame, list]:
    """Arrays of tracks and their sides with smoothed sizes."""
    b = g.box()
    cv = lambda c: F.stddev_pop(c) / F.greatest(F.avg(c), F.lit(1.0))
    # One aggregation for sizes and rows, so that the rows are read and shuffled once.
    sizes = [(cv(g.width(b)) + cv(g.height(b))).alias("_cv"), F.percentile(g.width(b), F.lit(0.5)).alias("_mw"), F.percentile(g.height(b), F.lit(0.5)).alias("_mh")]
    t = as_arrays(df, group, *sizes)
    cx, cy, w, h = _parts(t)
    size = lambda v, m: F.when(F.col("_cv") <= cv_threshold, F.array_repeat(F.col(m), F.size("rows"))).otherwise(signal.median_edge(v, window))
    t = t.select("*", size(w, "_mw").alias("_w"), size(h, "_mh").alias("_h"))
    return t, _sides(cx, cy, F.col("_w"), F.col("_h"))


def smooth_sizes(df: DataFrame, cv_threshold: float = 0.2, window: int = 21, group: tuple[str, ...] = TRACK) -> DataFrame:
    """One size for tracks whose size hardly varies (variation of both sides together up to the bound), else a running median; centres stay."""
    t, sides = _sized(df, cv_threshold, window, group)
    return _with_boxes(t, group, sides)


def smooth_tracks(df: DataFrame, cv_threshold: float = 0.2, window: int = 21, centre_window: int = 21, group: tuple[str, ...] = TRACK) -> DataFrame:
    """``smooth_centres`` of ``smooth_sizes`` over the same arrays: Spark takes rows that come from Python for rows dealt anyhow and would shuffle them between the two."""
    t, sides = _sized(df, cv_threshold, window, group)
    t = t.select(*group, "rows", *[s.alias(f"_s{i}") for i, s in enumerate(sides)])
    middle = lambda i: F.zip_with(f"_s{i}", f"_s{i + 2}", lambda a, b: (a + b) / 2)
    side = lambda i: F.zip_with(f"_s{i}", f"_s{i + 2}", lambda a, b: b - a)
    t = t.select(*group, "rows", signal.median_edge(middle(0), centre_window).alias("_cx"), signal.median_edge(middle(1), centre_window).alias("_cy"), side(0).alias("_w"), side(1).alias("_h"))
    return _with_boxes(t, group, _sides(*[F.col(c) for c in ("_cx", "_cy", "_w", "_h")]))
