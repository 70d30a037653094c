"""The whole chain and sweeps of it on random clips, against a plain version of every step."""

import math
import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_by_force import SCHEMA, merged_by_force, single_by_force

from trackloom.operators import graph, recover, resolve
from trackloom.plans import catalog, pipeline
from trackloom.sources import tables

BASE = pipeline.Config(
    min_total=4, min_conf=0.45, max_gap=3, merge_gap=12, merge_iou=0.2, long_gap=30, long_distance=25.0, overlap_iou=0.4, overlap_frames=3, trim_conf=0.0,
    median_window=5, sigma=1.0, most_tracks=9, gate_len=6, gate_mean=0.5, gate_p90=0.6, stitch_gap=60, stitch_jump=60.0, stitch_ratio=1.6, size_window=5, centre_window=7,
)


def random_boxes(rng, clips=3, people=9, frames=160):
    out = []
    for c in range(clips):
        for t in range(1, people + 1):
            at, x, y, step = rng.randrange(20), rng.uniform(0, 90), rng.uniform(0, 20), rng.uniform(-0.4, 0.4)
            while at < frames:
                for f in range(at, at + rng.randint(2, 25)):
                    if rng.random() < 0.85:
                        w, h = rng.uniform(24, 34), rng.uniform(40, 46)
                        out.append((f"c{c}", f, t if rng.random() < 0.9 else t + 20, x + step * f, y, x + step * f + w, y + h, round(rng.uniform(0.3, 1), 3)))
                at = f + rng.choice([2, 6, 14, 30])
    return [r for i, r in enumerate(out) if not any(r[:3] == q[:3] for q in out[:i])]


def filled(track):
    frames, out = sorted(track), dict(track)
    for a, b in zip(frames, frames[1:], strict=False):
        for f in range(a + 1, b):
            s = (f - a) / (b - a)
            out[f] = tuple(p + (q - p) * s for p, q in zip(track[a][0], track[b][0], strict=True)), track[a][1] + (track[b][1] - track[a][1]) * s
    return out


def conf(track):
    return [track[f][1] for f in sorted(track)]


def middle(values, window, pad):
    half = window // 2
    at = lambda i: values[min(max(i, 0), len(values) - 1)] if pad == "edge" else values[i] if 0 <= i < len(values) else 0.0
    return [sorted(at(i + k) for k in range(-half, half + 1))[half] for i in range(len(values))]


def odd(window, n):
    w = min(window, n)
    return max(w - (w % 2 == 0), 1)


def smooth(values, window, sigma):
    n = len(values)
    if n < max(window, 5):
        return values
    m, radius = middle(values, window, "zero"), int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]

    def mirrored(i):
        while not 0 <= i < n:
            i = -i - 1 if i < 0 else 2 * n - 1 - i
        return m[i]

    return [sum(w * mirrored(i + k) for w, k in zip(weights, range(-radius, radius + 1), strict=True)) / sum(weights) for i in range(n)]


def with_sides(track, columns):
    return {f: (tuple(c[i] for c in columns), track[f][1]) for i, f in enumerate(sorted(track))}


def centred(track, cx, cy, w, h):
    sides = [[p - q / 2 for p, q in zip(cx, w, strict=True)], [p - q / 2 for p, q in zip(cy, h, strict=True)], [p + q / 2 for p, q in zip(cx, w, strict=True)], [p + q / 2 for p, q in zip(cy, h, strict=True)]]
    return with_sides(track, sides)


def parts(track):
    b = [track[f][0] for f in sorted(track)]
    return [(x[0] + x[2]) / 2 for x in b], [(x[1] + x[3]) / 2 for x in b], [x[2] - x[0] for x in b], [x[3] - x[1] for x in b]


def quantile(values, q):
    v, at = sorted(values), q * (len(values) - 1)
    return v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))


def stitched(tracks, k):
    ends = {}
    for t, x in tracks.items():
        frames, (cx, cy, w, h) = sorted(x), parts(x)
        steps = [max(b - a, 1) for a, b in zip(frames[-5:], frames[-4:], strict=False)]
        v = [statistics.median([(b - a) / s for a, b, s in zip(c[-5:], c[-4:], steps, strict=False)]) if steps else 0.0 for c in (cx, cy)]
        ends[t] = frames[0], frames[-1], (cx[0], cy[0], w[0], h[0]), (cx[-1], cy[-1], w[-1], h[-1]), v
    found = []
    for a, (_, last, _, tail, v) in ends.items():
        for b, (first, _, head, _, _) in ends.items():
            if a != b and 1 <= first - last <= k.stitch_gap + 1:
                dx, dy = (x * (first - last) for x in v)
                s = min(1.0, 200 / math.hypot(dx, dy)) if math.hypot(dx, dy) else 1.0
                d = math.hypot(tail[0] + dx * s - head[0], tail[1] + dy * s - head[1])
                ratio = max(max(tail[i], head[i]) / max(min(tail[i], head[i]), 1) for i in (2, 3))
                if d <= k.stitch_jump and ratio <= k.stitch_ratio:
                    found.append((round(d, 6), a, b))
    tails, heads, name = set(), set(), {t: t for t in tracks}
    for _, a, b in sorted(found):
        if a not in tails and b not in heads:
            tails.add(a)
            heads.add(b)
            both = name[a], name[b]
            name = {t: min(both) if n in both else n for t, n in name.items()}
    out = {}
    for t in sorted(tracks):
        mine = out.setdefault(name[t], {})
        for f, v in tracks[t].items():
            if f not in mine or v[1] > mine[f][1]:
                mine[f] = v
    return out


def chain_by_force(rows, k):
    tracks = {}
    for f, t, *box, c in rows:
        if box[2] - box[0] > k.min_box and box[3] - box[1] > k.min_box:
            tracks.setdefault(t, {})[f] = (tuple(box), c)
    good = lambda x: len(x) >= k.min_total and statistics.fmean(conf(x)) >= k.min_conf
    pieces = {}
    for t, x in tracks.items():
        if good(x):
            piece, before = 0, None
            for f in sorted(x):
                piece += before is not None and f - before > k.max_gap
                pieces.setdefault(t * 1_000_000 + piece, {})[f] = x[f]
                before = f
    tracks = {t: y for t, x in pieces.items() if len(y := filled(x)) >= k.min_total}
    tracks = merged_by_force(tracks, k.merge_gap, k.merge_iou, k.long_gap, k.long_distance)[1]
    if k.overlap_iou > 0:
        tracks = single_by_force(tracks, k.overlap_iou, k.overlap_frames)
    out = {}
    for t, x in tracks.items():
        frames = sorted(x)
        if k.trim_conf > 0 and k.trim_frames > 0:
            low = [x[f][1] < k.trim_conf for f in frames]
            head = min(next((i for i, v in enumerate(low) if not v), len(low)), k.trim_frames)
            tail = min(next((i for i, v in enumerate(reversed(low)) if not v), len(low)), k.trim_frames, len(low) - head)
            frames = frames[head : len(low) - tail]
            if len(frames) < k.min_total:
                continue
        x = {f: x[f] for f in frames}
        out[t] = with_sides(x, [smooth([x[f][0][i] for f in frames], k.median_window, k.sigma) for i in range(4)])
    kept = sorted(out, key=lambda t: (-len(out[t]), t))[: k.most_tracks]
    tracks = {t: out[t] for t in kept if not k.use_gate or (len(out[t]) >= k.gate_len and statistics.fmean(conf(out[t])) >= k.gate_mean and quantile(conf(out[t]), 0.9) >= k.gate_p90)}
    if k.use_stitch:
        tracks = stitched(tracks, k)
    for t, x in tracks.items() if k.use_sizes else ():
        cx, cy, w, h = parts(x)
        if sum(statistics.pstdev(s) / max(statistics.fmean(s), 1) for s in (w, h)) <= k.size_cv:
            w, h = ([statistics.median(s)] * len(s) for s in (w, h))
        else:
            w, h = (middle(s, odd(k.size_window, len(s)), "edge") for s in (w, h))
        tracks[t] = centred(x, cx, cy, w, h)
    for t, x in tracks.items() if k.use_centres else ():
        cx, cy, w, h = parts(x)
        tracks[t] = centred(x, *(middle(s, odd(k.centre_window, len(s)), "edge") for s in (cx, cy)), w, h)
    return {(t, f): [*b, c] for t, x in tracks.items() for f, (b, c) in x.items()}


def by_force(rows, k):
    return {(c, *key): v for c in {r[0] for r in rows} for key, v in chain_by_force([r[1:] for r in rows if r[0] == c], k).items()}


def collected(df):
    return {(r.clip, r.tid, r.frame): [r.x1, r.y1, r.x2, r.y2, r.conf] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())


VARIANTS = {
    "base": BASE,
    "again": BASE,
    "gaps": replace(BASE, merge_gap=6, long_gap=20, long_distance=60.0),
    "piles": replace(BASE, overlap_iou=0.0),
    "trimmed": replace(BASE, trim_conf=0.5, trim_frames=2),
    "open": replace(BASE, use_gate=False, use_stitch=False, most_tracks=20),
    "plain": replace(BASE, use_sizes=False, use_centres=False, median_window=3, sigma=2.0),
    "varied": replace(BASE, size_cv=0.05, size_window=9, centre_window=3),
    "strict": replace(BASE, min_conf=0.6, stitch_jump=20.0),
}


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


@pytest.fixture(scope="module")
def clips():
    return random_boxes(random.Random(11))


def test_sweep_and_single_runs(spark, clips):
    df = spark.createDataFrame(clips, SCHEMA)
    wide = pipeline.sweep(df, VARIANTS).toPandas()
    for name, k in VARIANTS.items():
        got = {(r.clip, r.tid, r.frame): [r.x1, r.y1, r.x2, r.y2, r.conf] for r in wide[wide["variant"] == name].itertuples()}
        want = by_force(clips, k)
        same(got, want)
        assert want
    assert len({len(by_force(clips, k)) for k in VARIANTS.values()}) > 4
    same(collected(pipeline.build_tracks(df, VARIANTS["trimmed"])), by_force(clips, VARIANTS["trimmed"]))


def test_jobs_do_not_grow_with_variants(spark, clips):
    df = spark.createDataFrame(clips, SCHEMA)
    took = []
    for n in (2, 12):
        before = jobs(spark)
        pipeline.sweep(df, {f"v{i}": replace(BASE, min_conf=0.4 + 0.001 * i, stitch_jump=60.0 - i) for i in range(n)}).count()
        took.append(jobs(spark) - before)
    assert took[1] <= took[0] + 30, took  # rounds of matching and components follow the longest one of all variants, nothing else does


def test_recovered_boxes_go_through_the_chain(spark, clips):
    df = spark.createDataFrame(clips, SCHEMA)
    frames = df.select("clip").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(200).cast("long"))))
    back = [tuple(r) for r in recover.recovered(df, frames).collect()]
    assert len(back) > len(clips)
    same(collected(pipeline.run(df, frames, BASE, recovery=True)), by_force(back, BASE))


def test_catalog_variants(spark, sf):
    """``variant_sweep`` and ``build_tracks`` of the catalog on the given tables: sizes as the plain chain has them."""
    rows = [tuple(r) for r in tables.detections(spark, sf).collect()]
    want = by_force(rows, catalog.TEST_CONFIG)
    got = collected(catalog.QUERIES["build_tracks"](spark, sf))
    same(got, want)
    swept = {(r.variant, r.clip): (r.tracks, r.boxes) for r in catalog.QUERIES["variant_sweep"](spark, sf).collect()}
    for c in {k[0] for k in want}:
        assert swept["baseline", c] == (len({k[1] for k in want if k[0] == c}), sum(k[0] == c for k in want))


def test_islands_part_what_can_not_meet(spark):
    ends = spark.createDataFrame([("a", 1, 0, 50), ("a", 2, 10, 20), ("a", 3, 61, 70), ("a", 4, 81, 90), ("b", 5, 0, 1)], "clip string, tid long, f0 long, f1 long")
    got = {r.tid: (r.clip, r.island) for r in resolve.with_islands(ends, F.lit(10)).collect()}
    assert got == {1: ("a", 0), 2: ("a", 0), 3: ("a", 1), 4: ("a", 2), 5: ("b", 0)}


def test_matching_is_that_of_going_in_order(spark):
    rng = random.Random(6)
    edges = list({(rng.choice("xy"), rng.randrange(25), rng.randrange(25)) for _ in range(300)})
    edges = [(c, a, b, round(rng.random(), 2)) for c, a, b in edges]
    left, right, want = set(), set(), set()
    for d, c, a, b in sorted((d, c, a, b) for c, a, b, d in edges):
        if (c, a) not in left and (c, b) not in right:
            left.add((c, a))
            right.add((c, b))
            want.add((c, a, b))
    df = spark.createDataFrame(edges, "clip string, a long, b long, d double").withColumn("rank", F.struct("d", "a", "b"))
    got = graph.matched(df, ["clip", "a"], ["clip", "b"], "rank")
    assert {(r.clip, r.a, r.b) for r in got.collect()} == want


def test_components(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(c, rng.randrange(120), rng.randrange(120)) for c in "pq" for _ in range(70)] + [("r", i, i + 1) for i in range(200)] + [("s", 0, i) for i in range(1, 90)]
    root = {(c, v): (c, v) for c, *x in edges for v in x}

    def of(n):
        while root[n] != n:
            n = root[n]
        return n

    for c, a, b in edges:
        x, y = of((c, a)), of((c, b))
        root[max(x, y)] = min(x, y)
    linked = {(c, v) for c, a, b in edges if a != b for v in (a, b)}
    df = spark.createDataFrame(edges, "clip string, u long, v long").repartition(7).select(F.struct("clip", F.col("u").alias("tid")).alias("a"), F.struct("clip", F.col("v").alias("tid")).alias("b"))
    got = {tuple(r.node): tuple(r.component) for r in graph.connected_components(df).collect()}
    assert got == {n: of(n) for n in linked}
