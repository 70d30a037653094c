"""Order-dependent operators on random clips against plain, slow versions of their rules."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import resolve, score

SCHEMA = "clip string, frame long, tid long, x1 double, y1 double, x2 double, y2 double, conf double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


def random_tracks(rng, clips=3, tracks=14, length=12, frames=200):
    """{(clip, tid): {frame: (box, conf)}} without gaps; places drift, so that many pairs nearly fit."""
    out = {}
    for c in range(clips):
        for t in range(1, tracks + 1):
            begin, x, step = rng.randrange(frames), rng.uniform(0, 120), rng.uniform(-1, 1)
            n = rng.randint(1, length)
            out[f"c{c}", t] = {begin + k: ((x + step * k, 0.0, x + step * k + 30 + rng.random(), 40.0), round(rng.uniform(0.3, 1), 3)) for k in range(n)}
    return out


def table(spark, tracks):
    return spark.createDataFrame([(c, f, t, *map(float, b), float(conf)) for (c, t), x in tracks.items() for f, (b, conf) in x.items()], SCHEMA)


def predicted(track, at):
    frames = sorted(track)[-3:]
    if len(frames) < 2:
        return track[frames[-1]][0]
    m = sum(frames) / len(frames)
    out = []
    for k in range(4):
        v = [track[f][0][k] for f in frames]
        slope = sum((f - m) * (y - sum(v) / len(v)) for f, y in zip(frames, v, strict=True)) / sum((f - m) ** 2 for f in frames)
        out.append(sum(v) / len(v) + slope * (at - m))
    return out


def appended(a, b):
    """Rows of both with straight lines between."""
    f, g = max(a), min(b)
    line = lambda p, q, s: p + (q - p) * s
    mid = {k: (tuple(line(p, q, (k - f) / (g - f)) for p, q in zip(a[f][0], b[g][0], strict=True)), line(a[f][1], b[g][1], (k - f) / (g - f))) for k in range(f + 1, g)}
    return a | mid | b


def merged_by_force(tracks, max_gap, least, long_gap, far):
    """{member: id} by starting anew after every merge."""
    work = [(t, [t], x) for t, x in tracks.items()]
    order = lambda w: (min(w[2]), max(w[2]), w[0])

    def join(i, j):
        a, b = work[i], work[j]
        new = (a[0], a[1] + b[1], appended(a[2], b[2]))
        return sorted([w for k, w in enumerate(work) if k not in (i, j)] + [new], key=order)

    while True:
        work.sort(key=order)
        found = None
        for i, a in enumerate(work):
            fits = [(iou(predicted(a[2], min(b[2])), b[2][min(b[2])][0]), -j) for j, b in enumerate(work) if j != i and 1 <= min(b[2]) - max(a[2]) <= max_gap]
            fits = [x for x in fits if x[0] >= least]
            if fits:
                found = i, -max(fits)[1]
                break
        if not found:
            break
        work = join(*found)
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    while long_gap > max_gap and far < float("inf"):
        work.sort(key=order)
        best = []
        for (i, a), (j, b) in itertools.permutations(enumerate(work), 2):
            if max_gap < min(b[2]) - max(a[2]) <= long_gap:
                d = math.dist(centre(a[2][max(a[2])][0]), centre(b[2][min(b[2])][0]))
                if d <= far:
                    best.append((d, i, j))
        if not best:
            break
        work = join(*min(best)[1:])
    return {m: w[0] for w in work for m in w[1]}, {w[0]: w[2] for w in work}


@pytest.mark.parametrize("seed", range(3))
def test_merging(spark, seed):
    tracks = random_tracks(random.Random(seed))
    df = table(spark, tracks)
    for far in (float("inf"), 25.0):
        want, rows = {}, {}
        for c in {c for c, _ in tracks}:
            ids, merged = merged_by_force({t: x for (k, t), x in tracks.items() if k == c}, 20, 0.3, 60, far)
            want |= {(c, m): t for m, t in ids.items()}
            rows |= {(c, t): x for t, x in merged.items()}
        knobs = {"max_gap": 20, "iou": 0.3, "long_gap": 60, "max_distance": far}
        assert {(r.clip, r.tid): r.new_tid for r in resolve.id_mapping(df, **knobs).collect()} == want
        assert len({(c, t) for (c, _), t in want.items()}) < len(tracks)
        got = {(r.clip, r.tid, r.frame): (r.x1, r.x2, r.conf) for r in resolve.merge_ids(df, **knobs).collect()}
        assert got == {(c, t, f): pytest.approx((b[0], b[2], conf)) for (c, t), x in rows.items() for f, (b, conf) in x.items()}


def single_by_force(tracks, least, common):
    work = dict(tracks)

    def pairs():
        ids = sorted(work, key=lambda t: (place[t], t))
        for a, b in itertools.combinations(ids, 2):
            both = work[a].keys() & work[b].keys()
            if len(both) >= common and (m := sum(iou(work[a][f][0], work[b][f][0]) for f in both) / len(both)) >= least:
                yield -m, ids.index(a), ids.index(b), a, b

    place = {t: (min(x), max(x), t) for t, x in work.items()}
    while (best := min(pairs(), default=None)) is not None:
        a, b = best[3:]
        x, y, t = work.pop(a), work.pop(b), min(a, b)
        place[t] = place[a]
        work[t] = {f: x[f] if f not in y or (f in x and x[f][1] >= y[f][1]) else y[f] for f in x.keys() | y.keys()}
    return work


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_tracks(spark, seed):
    tracks = random_tracks(random.Random(10 + seed), frames=20)
    want = {}
    for c in {c for c, _ in tracks}:
        own = {t: x for (k, t), x in tracks.items() if k == c}
        want |= {(c, t, f): (b[0], conf) for t, x in single_by_force(own, 0.4, 3).items() for f, (b, conf) in x.items()}
    got = {(r.clip, r.tid, r.frame): (r.x1, r.conf) for r in resolve.merge_overlapping(table(spark, tracks), 0.4, 3).collect()}
    assert got == want and len({k[:2] for k in want}) < len(tracks)


def best_pairs(left, right, gain):
    """Largest total gain over all ways to pair; only pairs of some gain count."""
    small, large, flip = (left, right, False) if len(left) <= len(right) else (right, left, True)
    best = (0, [])
    for chosen in itertools.permutations([*large, *[None] * len(small)], len(small)):
        pairs = [(b, a) if flip else (a, b) for a, b in zip(small, chosen, strict=True) if b is not None]
        pairs = [p for p in pairs if gain(*p) > 0]
        best = max(best, (sum(gain(*p) for p in pairs), pairs), key=lambda x: x[0])
    return best[1]


def scores_by_force(pred, truth, least):
    frames = sorted({f for x in truth.values() for f in x})
    last, hits = {}, {o: [] for o in truth}
    matches = switches = 0
    distance = 0.0
    for f in frames:
        os, qs = [o for o in sorted(truth) if f in truth[o]], [q for q in sorted(pred) if f in pred[q]]
        v = {(o, q): iou(truth[o][f][0], pred[q][f][0]) for o in os for q in qs}
        v = {k: x for k, x in v.items() if x >= least}
        found = {}
        for o in os:
            if o in last and (o, last[o]) in v and last[o] not in found.values():
                found[o] = last[o]
        rest = {k: x for k, x in v.items() if k[0] not in found and k[1] not in found.values()}
        found |= dict(best_pairs(sorted({o for o, _ in rest}), sorted({q for _, q in rest}), lambda o, q: 10 + rest[o, q] if (o, q) in rest else 0))  # noqa: B023
        switches += sum(o in last and last[o] != q for o, q in found.items())
        distance += sum(1 - v[k] for k in found.items())
        matches += len(found)
        last |= found
        for o in os:
            hits[o].append(o in found)
    n = {(o, q): sum(f in pred[q] and iou(truth[o][f][0], pred[q][f][0]) >= least for f in truth[o]) for o in truth for q in pred}
    n = {k: x for k, x in n.items() if x}
    idtp = sum(n[k] for k in best_pairs(sorted({o for o, _ in n}), sorted({q for _, q in n}), lambda o, q: n.get((o, q), 0)))
    parts = ["".join("01"[h] for h in x).strip("0").split("0") for x in hits.values()]
    share = [sum(x) / len(x) for x in hits.values()]
    return {
        "n_frames": len(frames), "matches": matches, "switches": switches, "idtp": idtp, "fragments": sum(sum(bool(p) for p in x) - 1 for x in parts if any(x)),
        "mostly_tracked": sum(s >= 0.8 for s in share), "mostly_lost": sum(s < 0.2 for s in share), "motp": distance / matches if matches else None,
    }


@pytest.mark.parametrize("seed", range(3))
def test_scores(spark, seed):
    rng = random.Random(20 + seed)
    truth = random_tracks(rng, tracks=4, length=25, frames=8)
    pred = {(c, t if f0 % 2 else t + 50): {f: (tuple(v + rng.uniform(-9, 9) for v in b), conf) for f, (b, conf) in x.items() if rng.random() < 0.9} for f0, ((c, t), x) in enumerate(random_tracks(rng, tracks=2, length=25, frames=8).items())}
    pred |= {(c, t + 100): {f: (tuple(v + rng.uniform(-9, 9) for v in b), conf) for f, (b, conf) in x.items() if rng.random() < 0.8} for (c, t), x in truth.items()}
    pred = {k: x for k, x in pred.items() if x}
    got = {r.clip: r.asDict() for r in score.clip_metrics(table(spark, pred), table(spark, truth), 0.4).collect()}
    for c in {c for c, _ in truth}:
        want = scores_by_force({t: x for (k, t), x in pred.items() if k == c}, {t: x for (k, t), x in truth.items() if k == c}, 0.4)
        assert {k: got[c][k] for k in want} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    total = score.summary(score.clip_metrics(table(spark, pred), table(spark, truth), 0.4)).head()
    assert total.switches == sum(x["switches"] for x in got.values()) and total.min_idf1 == pytest.approx(min(x["idf1"] for x in got.values()))


def test_predictions_without_truth(spark):
    t = table(spark, {("a", 1): {0: ((0, 0, 10, 10), 1)}})
    p = table(spark, {("b", 1): {0: ((0, 0, 10, 10), 1)}})
    got = {r.clip: (r.n_truth, r.n_pred, r.misses, r.false_positives) for r in score.clip_metrics(p, t).collect()}
    assert got == {"a": (1, 0, 1, 0), "b": (0, 1, 0, 1)} and score.clip_metrics(p, t.where(F.lit(False))).count() == 1
