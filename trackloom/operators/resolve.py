"""Identity resolution: order-dependent merging inside parts of a clip that can't touch one another.

Spark finds candidates, cuts clips into such parts and relabels; a task decides for the parts dealt to it. Merging
only reads the ends of tracks (its last three rows and first one), so short- and long-gap merging get
a row for each track, and the tracks of one island of time at most. Overlapping tracks are decided by
component, stitching by edges that come first at both ends. Ties are settled by (first frame, last frame, id).

A knob is a number, or a Column over ``clip`` where clips differ in it.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import candidates, graph, ordered
from trackloom.sources.store import stored

MAPPING = "clip string, tid long, new_tid long, seq int"


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of every box of ``a`` with every box of ``b``."""
    side = lambda k: np.maximum(0, np.minimum(a[:, None, k + 2], b[None, :, k + 2]) - np.maximum(a[:, None, k], b[None, :, k]))
    inner = side(0) * side(1)
    area = lambda x: np.maximum(0, x[:, 2] - x[:, 0]) * np.maximum(0, x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None] - inner
    return np.where((inner > 0) & (union > 0), inner / np.where(union > 0, union, 1), 0.0)


class _Ends:
    """What merging needs of a track that may grow: ids in order, first box, last three rows (frame, x1, y1, x2, y2)."""

    def __init__(self, row):
        self.members, self.id = [int(row.tid)], int(row.tid)
        self.f0, self.f1 = int(row.f0), int(row.f1)
        self.head = [float(v) for v in row.head]
        self.tail = [[float(v) for v in x] for x in row.last]
        self.line = None
        self.looks = tuple(getattr(row, c, None) for c in ("head_look", "tail_look"))
        self.poses = tuple(getattr(row, c, None) for c in ("head_pose", "tail_pose"))

    def order(self):
        return self.f0, self.f1, self.id

    def at(self, frame: int) -> list[float]:
        """The box at a later frame, by a straight line through the last rows."""
        if len(self.tail) < 2:
            return self.tail[-1][1:5]
        if self.line is None:
            n = len(self.tail)
            mean = [sum(r[k] for r in self.tail) / n for k in range(5)]
            spread = sum((r[0] - mean[0]) ** 2 for r in self.tail)
            self.line = mean, [sum((r[0] - mean[0]) * (r[k] - mean[k]) for r in self.tail) / spread for k in range(1, 5)]
        mean, slope = self.line
        return [m + s * (frame - mean[0]) for m, s in zip(mean[1:], slope, strict=True)]

    def take(self, other: _Ends) -> None:
        """Append another track; the frames between are straight lines, which the last rows include."""
        end, first = self.tail[-1], [other.f0, *other.head]
        share = lambda f: (f - self.f1) / (other.f0 - self.f1)
        between = [[e + (o - e) * share(f) for e, o in zip(end, first, strict=True)] for f in range(max(self.f1 + 1, other.f0 - 3), other.f0)]
        self.tail, self.line = [*self.tail, *between, *other.tail][-3:], None
        self.members += other.members
        self.f1 = other.f1
        self.looks, self.poses = (None, None), (self.poses[0], other.poses[1])  # a merged track has no appearance
        if self.id < 0:
            self.id = other.id


def one_iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def look_cosine(a, b) -> float:
    """Cosine of two appearance vectors; 1 where either is missing."""
    if a is None or b is None or not len(a) or not len(b):
        return 1.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(a @ b / ((np.linalg.norm(a) + 1e-9) * (np.linalg.norm(b) + 1e-9)))


def pose_cosine(a, b, least: float = 0.3, points: int = 3) -> float:
    """Cosine of two poses (points, scores) over what both see; 0 where it is not known."""
    if a is None or b is None:
        return 0.0
    (p, s), (q, t) = ((np.array([list(x) for x in v["points"]], float), np.asarray(v["scores"], float)) for v in (a, b))
    both = (s >= least) & (t >= least)
    p, q = p[both].ravel(), q[both].ravel()
    norm = np.linalg.norm(p) * np.linalg.norm(q)
    return float(p @ q / norm) if both.sum() >= points and norm > 1e-9 else 0.0


def _heads(work: list[_Ends], t: _Ends, low: int, high: int) -> list[_Ends]:
    """Other tracks of a list in order that begin ``low`` to ``high`` frames after t ends."""
    start = bisect.bisect_left(work, t.f1 + low, key=lambda x: x.f0)
    stop = bisect.bisect_right(work, t.f1 + high, key=lambda x: x.f0)
    return [o for o in work[start:stop] if o is not t]


def merge_ends(tracks: list[_Ends], max_gap: int, iou: float, long_gap: int, max_distance: float, least_look: float = 0.0, least_pose: float = 0.0) -> list[_Ends]:
    """Short gaps: the first track with a fitting successor takes its best one, then all starts anew. Long gaps: the best pair of all, again and again.

    The best successor has the largest overlap plus half the cosine of appearance, which must be ``least_look`` where both
    have one. Over long gaps the closest pair goes first, then the one of more alike poses; a ``least_pose`` above 0 is a
    bound on these, and without a bound on distance they come first.

    Starting anew would find nothing before the place of the last merge: heads never change and one
    has gone. So the scan goes on from there.
    """
    work, at = sorted(tracks, key=_Ends.order), 0
    while at < len(work):
        t, best = work[at], None
        for o in _heads(work, t, 1, max_gap):
            score, look = one_iou(t.at(o.f0), o.head), look_cosine(t.looks[1], o.looks[0])
            if score < iou or (look < least_look and t.looks[1] is not None and o.looks[0] is not None):
                continue
            if best is None or score + 0.5 * look > best[0]:
                best = score + 0.5 * look, o
        if best is None:
            at += 1
            continue
        t.take(best[1])
        work = [x for x in work if x is not best[1] and x is not t]
        bisect.insort(work, t, key=_Ends.order)
    by_distance = max_distance != float("inf")
    if not (by_distance or least_pose > 0) or long_gap <= max_gap:
        return work
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    place, gone, version, heap = {id(t): i for i, t in enumerate(work)}, set(), {}, []

    def offer(t: _Ends) -> None:
        x, y = centre(t.tail[-1][1:5])
        for o in _heads(work, t, max_gap + 1, long_gap):
            u, v = centre(o.head)
            if id(o) not in gone and (d := math.hypot(x - u, y - v)) <= max_distance:
                alike = pose_cosine(t.poses[1], o.poses[0]) if least_pose > 0 else 0.0
                if alike >= least_pose:
                    rank = (d, -alike) if by_distance else (-alike, d)
                    heapq.heappush(heap, (rank, place[id(t)], place[id(o)], version.get(id(t), 0)))

    every = list(work)
    for t in every:
        offer(t)
    while heap:
        _, i, j, v = heapq.heappop(heap)
        t, o = every[i], every[j]
        if id(t) in gone or id(o) in gone or version.get(id(t), 0) != v:
            continue
        t.take(o)
        gone.add(id(o))
        version[id(t)] = v + 1
        offer(t)
    return [t for t in every if id(t) not in gone]


def with_islands(ends: DataFrame, reach: Column) -> DataFrame:
    """``ends`` with ``island``: a new one begins where no track of the clip ends within ``reach`` frames before a head, nor goes on.

    Merging links a tail to a head within ``reach`` after it, and a merged track ends where its last member does, so nothing
    ever links tracks of two islands. The windows see a row for each track and hold none of them.
    """
    w = Window.partitionBy("clip").orderBy("f0", "tid")
    before = F.max("f1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    far = F.when(F.col("f0") - before > reach, 1).otherwise(0)
    return ends.withColumn("_new", far).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def id_mapping(
    df: DataFrame, max_gap: int | Column = 48, iou: float | Column = 0.10, long_gap: int | Column = 120, max_distance: float | Column = 150.0, ids: str = "tid",
    look: str | None = None, least_look: float = 0.0, pose: tuple[str, str] | None = None, least_pose: float = 0.0,
) -> DataFrame:
    """(clip, tid, new_tid, seq): which tracks are one, and their order in it. Rows of ``df`` must be without gaps inside a track.

    ``look`` names a column of appearance vectors, ``pose`` those of key points (array of [x, y]) and their scores.
    """
    last = Window.partitionBy("clip", ids).orderBy(F.col("frame").desc())
    rows = df.withColumn("_last", F.when(F.row_number().over(last) <= 3, F.array(F.col("frame").cast("double"), *g.BOX)))
    more = {"look": F.col(look).cast("array<double>")} if look else {}
    if pose:
        more["pose"] = F.struct(g.normalised_points(F.col(pose[0]), g.box()).alias("points"), F.col(pose[1]).cast("array<double>").alias("scores"))
    at_ends = [f(v, "frame").alias(f"{end}_{k}") for k, v in more.items() for end, f in (("head", F.min_by), ("tail", F.max_by))]
    # One shuffle: the aggregation finds the rows where the window has put them.
    spans = [F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min_by(F.array(*g.BOX), "frame").alias("head"), F.array_sort(F.collect_list("_last")).alias("last")]
    ends = rows.groupBy("clip", ids).agg(*spans, *at_ends).withColumnRenamed(ids, "tid")
    knobs = {"max_gap": max_gap, "iou": iou, "long_gap": long_gap, "max_distance": max_distance}
    ends = with_islands(ends, F.greatest(F.lit(max_gap), F.lit(long_gap)))
    ends = ends.withColumns({**{k: F.lit(v).cast("double") for k, v in knobs.items()}, "_n": F.count("*").over(Window.partitionBy("clip", "island"))})
    ends = stored(ends, "merge-ends")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        merged = merge_ends([_Ends(r) for r in pdf.itertuples()], int(one["max_gap"]), one["iou"], int(one["long_gap"]), one["max_distance"], least_look, least_pose)
        return pd.DataFrame([(one["clip"], m, t.id, i) for t in merged for i, m in enumerate(t.members)], columns=["clip", "tid", "new_tid", "seq"])

    alone = ends.where("_n = 1").select("clip", F.col("tid").cast("long").alias("tid"), F.col("tid").cast("long").alias("new_tid"), F.lit(0).alias("seq"))
    # What an island costs is not in its bytes, so its rows are spread over all partitions however small they are.
    many = ends.where("_n > 1").drop("_n").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "clip", "island")
    return many.groupBy("clip", "island").applyInPandas(decide, MAPPING).unionByName(alone)


def relabel(df: DataFrame, mapping: DataFrame, ids: str = "tid") -> DataFrame:
    m = mapping.select("clip", F.col("tid").alias(ids), "new_tid")
    return df.join(m, ["clip", ids]).withColumn(ids, F.col("new_tid")).drop("new_tid")


def merge_ids(df: DataFrame, **knobs) -> DataFrame:
    """Tracks with merged ids; the gaps that merging leaves are filled by straight lines."""
    rows = relabel(df.select("clip", "frame", "tid", *ordered.VALUES), id_mapping(df, **knobs))
    return ordered.fill_gaps(rows, ("clip", "tid")).drop("detected")


class _Pile:
    """Tracks of one component that lie on one another, merged best pair first."""

    def __init__(self, rows: dict[int, dict[int, list[float]]], least: float, min_frames: int):
        self.rows, self.least, self.min_frames = rows, least, min_frames
        self.place = {t: i for i, t in enumerate(sorted(rows, key=lambda t: (min(rows[t]), max(rows[t]), t)))}
        self.near: dict[int, set[int]] = {t: set() for t in rows}

    def overlap(self, a: int, b: int) -> float | None:
        x, y = self.rows[a], self.rows[b]
        common = x.keys() & y.keys()
        if len(common) < self.min_frames:
            return None
        m = sum(one_iou(x[f], y[f]) for f in common) / len(common)
        return m if m >= self.least else None

    def merged(self, pairs: list[tuple[int, int, float | None]]) -> dict[int, dict[int, list[float]]]:
        """``pairs`` are all that touch in some frame, with their mean overlap where it is enough. Only neighbours of a merged track are tried again."""
        found: dict[tuple[int, int], float] = {}
        for a, b, m in pairs:
            self.near[a].add(b)
            self.near[b].add(a)
            if m is not None:
                found[tuple(sorted((a, b), key=self.place.__getitem__))] = m
        while found:
            a, b = min(found, key=lambda p: (-found[p], self.place[p[0]], self.place[p[1]]))
            x, y, t = self.rows.pop(a), self.rows.pop(b), min(a, b)
            self.rows[t] = {f: x[f] if f not in y or (f in x and x[f][4] >= y[f][4]) else y[f] for f in x.keys() | y.keys()}
            self.place[t] = self.place[a]
            around = (self.near.pop(a) | self.near.pop(b)) - {a, b}
            self.near[t] = around
            found = {p: m for p, m in found.items() if a not in p and b not in p}
            for k in around:
                self.near[k] = (self.near[k] - {a, b}) | {t}
                pair = (k, t) if self.place[k] < self.place[t] else (t, k)
                if (m := self.overlap(*pair)) is not None:
                    found[pair] = m
        return self.rows


def merge_overlapping(df: DataFrame, iou: float | Column = 0.7, min_frames: int | Column = 5, thin: bool = False) -> DataFrame:
    """Tracks that lie on one another for some frames become one: the best pair each round, higher confidence in common frames, smaller id.

    A merged track can only come to lie on a track that one of its members touches, so components of the pairs that touch in
    any frame are independent of one another; those with a pair to merge are decided, a component at a time, and all other tracks pass by.

    ``thin`` rows stand for tracks with straight lines between them, which are drawn where overlaps are found and decided; tracks that pass by stay
    thin, and merged ones, which have common frames, are without gaps.
    """
    pairs = stored(candidates.touching_pairs(df, iou, min_frames, thin=thin), "overlap-pairs")
    mine = df.select("clip", "frame", "tid", *ordered.VALUES)
    if pairs.where("mean_iou is not null").isEmpty():
        return mine
    track = lambda c: F.struct("clip", F.col(c).alias("tid"))
    parts = graph.connected_components(pairs.select(track("a_tid").alias("a"), track("b_tid").alias("b")), "overlap-parts")
    parts = parts.select("node.clip", "node.tid", F.col("component.tid").alias("part"))
    pairs = pairs.withColumnRenamed("a_tid", "tid").join(parts, ["clip", "tid"]).withColumnRenamed("tid", "a_tid")
    busy = pairs.where("mean_iou is not null").select("clip", "part").distinct()
    pairs = pairs.join(busy, ["clip", "part"], "left_semi").withColumns({"least": F.lit(iou).cast("double"), "min_frames": F.lit(min_frames).cast("int")})
    linked = stored(parts.join(busy, ["clip", "part"], "left_semi"), "overlap-linked")

    def decide(pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        clip, rows = pdf["clip"].iloc[0], {}
        for f, t, *v in pdf[["frame", "tid", *ordered.VALUES]].itertuples(index=False):
            rows.setdefault(t, {})[f] = v
        pile = _Pile(rows, given["least"].iloc[0], int(given["min_frames"].iloc[0]))
        links = [(a, b, None if math.isnan(m) else m) for a, b, m in zip(given["a_tid"], given["b_tid"], given["mean_iou"].astype(float), strict=True)]
        out = [(clip, f, t, *v) for t, x in pile.merged(links).items() for f, v in x.items()]
        return pd.DataFrame(out, columns=["clip", "frame", "tid", *ordered.VALUES])

    own = mine.join(linked, ["clip", "tid"])
    own = ordered.fill_gaps(own, ("clip", "part", "tid")).drop("detected") if thin else own
    done = own.groupBy("clip", "part").cogroup(pairs.groupBy("clip", "part")).applyInPandas(decide, "clip string, frame long, tid long, x1 double, y1 double, x2 double, y2 double, conf double")
    return mine.join(linked, ["clip", "tid"], "left_anti").select(*done.columns).unionByName(done)


def _stitch_pairs(df: DataFrame, max_gap: int | Column = 400, max_jump: float | Column = 2000.0, max_ratio: float | Column = 4.0, window: int = 5, cap: float = 200.0) -> DataFrame:
    c = candidates.stitch_candidates(ordered.endpoints(df, window=window), max_gap, max_jump, max_ratio, cap)
    return c.select(F.col("a_clip").alias("clip"), F.col("a_tid").alias("a"), F.col("b_tid").alias("b"), "gap", "px", "py", "pos_diff", "w_ratio", "h_ratio", "size_ok", "pos_ok")


def _accepted(pairs: DataFrame) -> DataFrame:
    good = pairs.where("size_ok and pos_ok").select("clip", "a", "b", F.struct(F.round("pos_diff", 6).alias("d"), "a", "b").alias("rank"))
    return graph.matched(good, ["clip", "a"], ["clip", "b"], "rank", "stitch-rounds").select("clip", "a", "b")


def stitch_links(df: DataFrame, **knobs) -> DataFrame:
    """(clip, a, b): the pairs that ``stitch_log`` has as stitched."""
    return _accepted(stored(_stitch_pairs(df, **knobs), "stitch-pairs"))


def stitch_log(df: DataFrame, max_gap: int | Column = 400, max_jump: float | Column = 2000.0, max_ratio: float | Column = 4.0, window: int = 5, cap: float = 200.0) -> DataFrame:
    """Every candidate pair with ``stitched`` and, where a tail or head was taken, ``skipped`` = conflict.

    Pairs that pass both gates are accepted by position error (to six places, then by ids), smallest first; a track is tail once and head once.
    """
    c = stored(_stitch_pairs(df, max_gap, max_jump, max_ratio, window, cap), "stitch-pairs")
    taken = _accepted(c).withColumn("_taken", F.lit(True))
    out = c.join(taken, ["clip", "a", "b"], "left").withColumn("stitched", F.coalesce("_taken", F.lit(False)))
    conflict = F.when(F.col("size_ok") & F.col("pos_ok") & ~F.col("stitched"), "conflict")
    return out.withColumn("skipped", conflict).select(*c.columns, "stitched", "skipped")


def stitch_components(links: DataFrame) -> DataFrame:
    """(clip, tid, new_tid): chains of accepted pairs take their smallest id."""
    track = lambda c: F.struct("clip", F.col(c).alias("tid"))
    parts = graph.connected_components(links.select(track("a").alias("a"), track("b").alias("b")), "stitch-chains")
    return parts.select("node.clip", "node.tid", F.col("component.tid").alias("new_tid"))


def renamed(df: DataFrame) -> DataFrame:
    """Rows (clip, new_tid, tid, frame, values) under their new names; of equal frames the higher confidence stays, then the smaller old id."""
    best = F.max_by(F.struct(*ordered.VALUES), F.struct("conf", -F.col("tid")))
    return df.groupBy("clip", "new_tid", "frame").agg(best.alias("b")).select("clip", "frame", F.col("new_tid").alias("tid"), "b.*")


def stitch(df: DataFrame, **knobs) -> DataFrame:
    """Tracks stitched across long gaps, which are not filled; of equal frames the higher confidence stays. Tracks without a link pass by."""
    cols = ["clip", "frame", "tid", *ordered.VALUES]
    # Read for the ends, for tracks with links and for those without.
    df = stored(df.select(*cols), "stitch-rows")
    m = stored(stitch_components(stitch_links(df, **knobs)), "stitch-names")
    one = renamed(df.join(m, ["clip", "tid"]))
    return df.join(m, ["clip", "tid"], "left_anti").select(*cols).unionByName(one)
