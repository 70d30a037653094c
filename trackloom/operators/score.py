"""Scoring against ground truth: matching in each frame, CLEAR counts and identity measures.

Matching goes on from frame to frame, so the rows of a clip stream through one task in order of frames; it
holds a frame, the last match and a tally of each object. Common frames of two ids are counted by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators.frames import Frame, frames_of
from trackloom.sources.store import stored

COUNTS = ["n_frames", "n_truth", "n_pred", "matches", "misses", "false_positives", "switches", "fragments", "truth_ids", "pred_ids", "mostly_tracked", "partly_tracked", "mostly_lost", "idtp"]
RATES = ["idf1", "idp", "idr", "mota", "motp", "precision", "recall"]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost (Hungarian method with potentials); infinite cells are never paired."""
    n, m = cost.shape
    if not n or not m:
        return []
    big = (np.abs(cost[np.isfinite(cost)]).sum() + 1) * 2
    size = max(n, m)
    c = np.full((size + 1, size + 1), big)
    c[1 : n + 1, 1 : m + 1] = np.where(np.isfinite(cost), cost, big)
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], col = i, 0
        least, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while True:
            used[col] = True
            row = match[col]
            free = ~used
            free[0] = False
            reduced = c[row] - u[row] - v
            better = free & (reduced < least)
            least[better], way[better] = reduced[better], col
            nxt = int(np.argmin(np.where(free, least, np.inf)))
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[free] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col] = match[way[col]]
            col = way[col]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if 1 <= match[j] <= n and np.isfinite(cost[match[j] - 1, j - 1])]


def frame_pairs(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(clip, frame, o, p, iou): boxes of the same frame that overlap enough. The join is on clip and frame."""
    a = truth.select("clip", "frame", F.col("tid").alias("o"), *[F.col(c).alias(f"o_{c}") for c in g.BOX])
    b = pred.select("clip", "frame", F.col("tid").alias("p"), *[F.col(c).alias(f"p_{c}") for c in g.BOX])
    return a.join(b, ["clip", "frame"]).withColumn("iou", g.iou(g.box("o_"), g.box("p_"))).where(F.col("iou") >= least).select("clip", "frame", "o", "p", "iou")


def assigned(cost: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Pairs of least total cost among those given; what is not linked over common ids is settled apart."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    for o, q in cost:
        parent[root((0, o))] = root((1, q))
    parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for pair in sorted(cost):
        parts.setdefault(root((0, pair[0])), []).append(pair)
    out = []
    for pairs in parts.values():
        if len(pairs) == 1:
            out += pairs
            continue
        os, qs = sorted({o for o, _ in pairs}), sorted({q for _, q in pairs})
        row, col = {o: i for i, o in enumerate(os)}, {q: j for j, q in enumerate(qs)}
        m = np.full((len(os), len(qs)), np.inf)
        for o, q in pairs:
            m[row[o], col[q]] = cost[o, q]
        out += [(os[i], qs[j]) for i, j in assign(m)]
    return out


TALLY = ["n_frames", "n_truth", "matches", "switches", "fragments", "truth_ids", "mostly_tracked", "partly_tracked", "mostly_lost"]


class _Clip:
    """Counts of one clip, frame by frame. A pair that matched in the frame before stays matched while it overlaps; the rest are assigned by least distance."""

    def __init__(self, clip: str):
        self.clip, self.last = clip, {}
        self.frames = self.objects = self.matches = self.switches = 0
        self.distance = 0.0
        self.seen: dict[int, list[int]] = {}  # frames, tracked frames, times lost, tracked in the last one

    def add(self, f: Frame) -> None:
        own, pairs = f["pair"] == 0, f["pair"] == 1
        iou = dict(zip(zip(f["o"][pairs].tolist(), f["p"][pairs].tolist(), strict=True), f["iou"][pairs].tolist(), strict=True))
        objects, found = sorted(f["o"][own].tolist()), {}
        taken: set[int] = set()
        for o in objects:
            q = self.last.get(o)
            if q is not None and (o, q) in iou and q not in taken:
                found[o] = q
                taken.add(q)
        found |= dict(assigned({k: 1 - v for k, v in iou.items() if k[0] not in found and k[1] not in taken}))
        self.distance += sum(1 - iou[k] for k in found.items())
        for o in objects:
            t, hit = self.seen.setdefault(o, [0, 0, 0, 0]), int(o in found)
            t[2] += t[3] and not hit
            t[0], t[1], t[3] = t[0] + 1, t[1] + hit, hit
        self.switches += sum(o in self.last and self.last[o] != q for o, q in found.items())
        self.last |= found
        self.frames, self.objects, self.matches = self.frames + bool(objects), self.objects + len(objects), self.matches + len(found)

    def row(self) -> list:
        share = [t[1] / t[0] for t in self.seen.values()]
        fragments = sum(t[2] - (0 if t[3] else int(t[1] > 0)) for t in self.seen.values())
        parts = [sum(x >= 0.8 for x in share), sum(0.2 <= x < 0.8 for x in share), sum(x < 0.2 for x in share)]
        return [self.clip, self.frames, self.objects, self.matches, self.switches, fragments, len(share), *parts, self.distance]


def tallies(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for each clip of ``truth``: ``TALLY`` and the sum of distances of matches."""
    none = F.lit(0).cast("long").alias("p"), F.lit(0.0).alias("iou")
    rows = truth.select("clip", "frame", F.col("tid").alias("o"), *none, F.lit(0).alias("pair")).unionByName(pairs.withColumn("pair", F.lit(1)))
    names = ["clip", *TALLY, "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, done = None, []
        for f in frames_of(batches):
            if clip is None or clip.clip != f["clip"][0]:
                done += [clip.row()] if clip else []
                clip = _Clip(f["clip"][0])
            clip.add(f)
        done += [clip.row()] if clip else []
        types = [pa.string(), *[pa.int64()] * len(TALLY), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)

    return rows.repartition("clip").sortWithinPartitions("clip", "frame", "pair", "o").mapInArrow(run, "clip string, " + ", ".join(f"{c} long" for c in TALLY) + ", distance double")


def identity_matches(pairs: DataFrame) -> DataFrame:
    """(clip, idtp): one prediction for each object over the whole clip, so that most frames agree. A task sees a row for each two ids that meet."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(zip(pdf["o"], pdf["p"], strict=True), pdf["n"], strict=True))
        # Without a partner an object adds nothing, so pairs that never meet may stand in the matrix at no cost.
        return pd.DataFrame({"clip": pdf["clip"].iloc[:1], "idtp": [int(sum(n.get(k, 0) for k in most_common(n)))]})

    return pairs.groupBy("clip", "o", "p").agg(F.count("*").alias("n")).groupBy("clip").applyInPandas(best, "clip string, idtp long")


def most_common(n: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Pairs of the largest total count, one for each id on either side."""
    parts: dict[int, dict[tuple[int, int], int]] = {}
    part: dict[tuple[int, int], int] = {}
    for o, q in sorted(n):
        mine, other = part.get((0, o)), part.get((1, q))
        at = min(x for x in (mine, other, len(part)) if x is not None)
        for old in {mine, other} - {None, at}:
            for k in parts.pop(old):
                part[0, k[0]] = part[1, k[1]] = at
                parts.setdefault(at, {})[k] = n[k]
        part[0, o] = part[1, q] = at
        parts.setdefault(at, {})[o, q] = n[o, q]
    out = []
    for p in parts.values():
        os, qs = sorted({o for o, _ in p}), sorted({q for _, q in p})
        out += [(os[i], qs[j]) for i, j in assign(np.array([[-float(p.get((o, q), 0)) for q in qs] for o in os]))]
    return out


def clip_metrics(pred: DataFrame, truth: DataFrame, least: float = 0.5, keys: tuple[str, ...] = ("clip",)) -> DataFrame:
    """A row for each clip: counts and rates. ``keys`` may hold more than the clip, e.g. a variant."""
    one = F.concat_ws("\x1f", *keys)
    box = ["frame", "tid", *g.BOX]
    p, t = (df.select(one.alias("clip"), *box) for df in (pred, truth))
    pairs = stored(frame_pairs(p, t, least), "score-pairs")
    sizes = p.groupBy("clip").agg(F.count("*").alias("n_pred"), F.countDistinct("tid").alias("pred_ids"))
    counts = tallies(pairs, t).join(sizes, "clip", "full").join(identity_matches(pairs), "clip", "left").na.fill(0)
    counts = counts.withColumns({"misses": F.col("n_truth") - F.col("matches"), "false_positives": F.col("n_pred") - F.col("matches")})
    rate = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    out = counts.select(
        F.split("clip", "\x1f").alias("_k"), *COUNTS,
        rate(2 * c("idtp"), c("n_truth") + c("n_pred")).alias("idf1"), rate(c("idtp"), c("n_pred")).alias("idp"), rate(c("idtp"), c("n_truth")).alias("idr"),
        (1 - rate(c("misses") + c("false_positives") + c("switches"), c("n_truth"))).alias("mota"), rate(c("distance"), c("matches")).alias("motp"),
        rate(c("matches"), c("n_pred")).alias("precision"), rate(c("matches"), c("n_truth")).alias("recall"),
    )
    return out.select(*[c("_k")[i].alias(k) for i, k in enumerate(keys)], *COUNTS, *RATES)


def summary(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median and least idf1, mean mota and sums of counts."""
    fine = lambda x: g.finite(F.col(x))
    aggs = [F.avg(fine("idf1")).alias("mean_idf1"), F.percentile(fine("idf1"), F.lit(0.5)).alias("median_idf1"), F.min(fine("idf1")).alias("min_idf1"), F.avg(fine("mota")).alias("mean_mota"), F.sum("switches").alias("switches"), F.sum("misses").alias("misses"), F.sum("false_positives").alias("false_positives"), F.count("*").alias("clips")]
    return metrics.groupBy(*by).agg(*aggs) if by else metrics.agg(*aggs)
