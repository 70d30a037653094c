"""Boxes as Column expressions: overlap, centres, sizes, jumps, similarity. All run inside generated code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box in four columns named with a prefix or suffix."""
    return Box(*[F.col(f"{prefix}{c}{suffix}") for c in BOX])


def field_box(s: Column) -> Box:
    return Box(*[s[c] for c in BOX])


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def area(b: Box) -> Column:
    """Zero where a side is negative."""
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where boxes don't meet."""
    inner = area(Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2)))
    union = area(a) + area(b) - inner
    return F.when(inner > 0, inner / union).otherwise(0.0)


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def capped(dx: Column, dy: Column, cap: float) -> tuple[Column, Column]:
    """A jump scaled back to at most ``cap``."""
    norm = F.sqrt(dx * dx + dy * dy)
    scale = F.when(norm > cap, F.lit(cap) / norm).otherwise(1.0)
    return dx * scale, dy * scale


def side_ratio(a: Column, b: Column) -> Column:
    """Larger side over the smaller, which counts as 1 at least."""
    return F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1.0))


def flipped(b: Box, frame_width: Column | float) -> Box:
    """The box in the mirrored frame, back in the original."""
    w = F.lit(frame_width) if isinstance(frame_width, (int, float)) else frame_width
    return Box(w - b.x2, b.y1, w - b.x1, b.y2)


def padded_crop(b: Box, share: float, frame_width: int, frame_height: int) -> Box:
    """The box with a margin on each side, cut to the frame, whole pixels."""
    dx, dy = width(b) * share, height(b) * share
    return Box(F.greatest(F.floor(b.x1 - dx), F.lit(0)), F.greatest(F.floor(b.y1 - dy), F.lit(0)), F.least(F.ceil(b.x2 + dx), F.lit(frame_width)), F.least(F.ceil(b.y2 + dy), F.lit(frame_height)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; norms are kept from zero by 1e-9."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def visible_centroid(points: Column, scores: Column, least: float) -> Column:
    """struct(x, y, n): mean of the points (array of [x, y]) whose score is at least ``least``; null without any."""
    both = F.filter(F.arrays_zip(points.alias("p"), scores.alias("s")), lambda z: z["s"] >= least)
    n = F.size(both)
    mean = lambda i: F.aggregate(both, F.lit(0.0), lambda acc, z: acc + z["p"][i]) / n
    return F.when(n > 0, F.struct(mean(0).alias("x"), mean(1).alias("y"), n.alias("n")))


def normalised_points(points: Column, b: Box) -> Column:
    """Key points relative to the box centre in half extents, which count as 1 at least."""
    cx, cy = centre(b)
    hw, hh = F.greatest(width(b) / 2, F.lit(1.0)), F.greatest(height(b) / 2, F.lit(1.0))
    return F.transform(points, lambda p: F.array((p[0] - cx) / hw, (p[1] - cy) / hh))


def pose_cosine(a: Column, sa: Column, b: Column, sb: Column, least: float = 0.3, points: int = 3) -> Column:
    """Cosine over the points that both see; null with fewer than ``points`` of them or a zero norm."""
    z = F.filter(F.arrays_zip(a.alias("a"), sa.alias("sa"), b.alias("b"), sb.alias("sb")), lambda r: (r["sa"] >= least) & (r["sb"] >= least))
    total = lambda f: F.aggregate(z, F.lit(0.0), lambda acc, r: acc + f(r))
    ab = total(lambda r: r["a"][0] * r["b"][0] + r["a"][1] * r["b"][1])
    aa, bb = total(lambda r: r["a"][0] * r["a"][0] + r["a"][1] * r["a"][1]), total(lambda r: r["b"][0] * r["b"][0] + r["b"][1] * r["b"][1])
    return F.when((F.size(z) >= points) & (aa > 1e-18) & (bb > 1e-18), ab / (F.sqrt(aa) * F.sqrt(bb)))


def weighted_similarity(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are known, from [-1, 1] to [0, 1]; 0 if none is."""
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, (total / weight + 1) / 2).otherwise(0.0)


def auto_gamma(luma: Column) -> Column:
    """Brightening exponent of a frame by its mean luma: 1 at 90 and above, 2.5 from 45 down."""
    return 1 + F.least(F.greatest((90 - luma) / 30, F.lit(0.0)), F.lit(1.5))


def effective_conf(base: float, luma: Column, dark_below: float = 80.0, delta: float = 0.05) -> Column:
    """Detector threshold of a frame, lowered on dark ones to 0.05 at least."""
    return F.when(luma < dark_below, F.greatest(F.lit(0.05), F.lit(base - delta))).otherwise(F.lit(base))


def hue(tid: Column) -> Column:
    """A hue in [0, 1) for an id, by the golden ratio."""
    return (tid * F.lit(0.61803398875)) % 1


def file_label(name: Column) -> Column:
    """A name fit for files: anything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def finite(c: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
