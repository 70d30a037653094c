"""State that goes on between micro-batches."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.streaming import live, motion

BOXES = "clip string, frame long, x1 double, y1 double, x2 double, y2 double, conf double"


def tracked(spark, folder, per_batch, out):
    stream = spark.readStream.schema(BOXES).option("maxFilesPerTrigger", per_batch).parquet(str(folder))
    rows = live.drained(live.online_tracks(stream), str(out / "rows"), str(out / "state")).collect()
    return sorted((r.clip, r.frame, r.tid, r.x1) for r in rows)


def test_ids_go_on_over_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, f, 60.0 * k + rng.uniform(-4, 4), 0.0, 60.0 * k + 40, 40.0, 0.9) for c in ("a", "b") for f in range(30) for k in range(3) if rng.random() < 0.8]
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):  # six frames a file, in order of time
        part = spark.createDataFrame([r for r in rows if r[1] // 6 == i], BOXES).coalesce(1)
        part.write.parquet(str(tmp_path / f"part{i}"))
        (name,) = [x for x in os.listdir(tmp_path / f"part{i}") if x.endswith(".parquet")]
        os.rename(tmp_path / f"part{i}" / name, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    one = tracked(spark, folder, 10, tmp_path / "one")
    many = tracked(spark, folder, 1, tmp_path / "many")
    assert many == one and len(many) == len(rows)
    assert len({r[:1] + r[2:3] for r in many}) == 6  # three tracks a clip, never begun anew


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    for i, hours in enumerate(([0, 1, 2], [30], [32], [3, 33])):
        at = F.expr(f"explode(array({', '.join(map(str, hours))}))")
        df = spark.range(1).select(at.alias("h")).select(F.col("h").cast("long").alias("event_id"), F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
        df.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (name,) = [x for x in os.listdir(tmp_path / f"p{i}") if x.endswith(".parquet")]
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(tmp_path / f"p{i}" / name, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = live.window_counts(live.event_stream(spark, str(tmp_path / "in"), "*"), "6 hours")
    got = live.drained(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r.start.hour, r.n) for r in got] == [(0, 3)]  # hour 3 came after its window had closed; the last window is still open


def files_of(spark, tmp_path, rows, schema, pieces, of):
    """Rows dealt into files by ``of``, in the order in which a stream takes them."""
    folder = tmp_path / "motion"
    folder.mkdir()
    for i in range(pieces):
        spark.createDataFrame([r for r in rows if of(r) == i], schema).coalesce(1).write.parquet(str(tmp_path / f"m{i}"))
        (name,) = [x for x in os.listdir(tmp_path / f"m{i}") if x.endswith(".parquet")]
        os.rename(tmp_path / f"m{i}" / name, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


def moved(spark, folder, per_batch, out, schema, **knobs):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(folder))
    with motion.state_store(spark):
        rows = live.drained(motion.motion_tracks(stream, **knobs), str(out / "rows"), str(out / "state")).collect()
    return sorted((r.clip, r.frame, r.x1, r.tid) for r in rows)


def test_hidden_tracks_keep_their_ids(spark, tmp_path):
    """A person who walks on while hidden: found again by motion, a new one to the tracker that only knows the last box."""
    rng = random.Random(3)
    rows = [("a", f, 5.0 * f + rng.uniform(-0.5, 0.5), 0.0, 5.0 * f + 30, 80.0, 0.9) for f in range(60) if not 25 <= f < 37]
    rows += [("a", f, 400.0 - 5 * f, 200.0, 430.0 - 5 * f, 280.0, 0.9) for f in range(60) if not 30 <= f < 40]
    folder = files_of(spark, tmp_path, rows, BOXES, 5, lambda r: r[1] // 12)
    plain = tracked(spark, folder, 10, tmp_path / "plain")
    assert len({r[2] for r in plain}) > 2
    one = moved(spark, folder, 10, tmp_path / "one", BOXES)
    many = moved(spark, folder, 1, tmp_path / "many", BOXES)
    assert one == many and len(one) == len(rows)
    by_row = {r[:3]: r[3] for r in one}
    assert len(set(by_row.values())) == 2 and len({by_row[r[:3]] for r in rows[:48]}) == 1


def test_looks_tell_crossing_tracks_apart(spark, tmp_path):
    schema = BOXES + ", look array<double>"
    rows = []
    for f in range(40):
        for k, look in ((0, [1.0, 0.0]), (1, [0.0, 1.0])):
            x = 100.0 + 0.01 * k + (1 - 2 * k) * (f - 20) * 0.4
            rows.append(("a", f, x, 0.0, x + 40, 80.0, 0.9, look))
    folder = files_of(spark, tmp_path, rows, schema, 2, lambda r: r[1] // 20)
    got = {r[:3]: r[3] for r in moved(spark, folder, 1, tmp_path / "out", schema, weight=0.6)}
    by_look = {}
    for r in rows:
        by_look.setdefault(tuple(r[7]), set()).add(got[r[:3]])
    assert all(len(ids) == 1 for ids in by_look.values()) and len(set.union(*by_look.values())) == 2


def test_forgotten_and_late(spark, tmp_path):
    """After more frames than the memory an id is not taken up again; rows behind a clip's last frame have no id, rows behind the watermark are gone."""
    box = lambda f, y=0.0: ("a", f, 0.0, y, 30.0, y + 60, 0.9)
    rows = [[box(0), box(1)], [box(50)], [box(49), ("b", 50, 0.0, 0.0, 30.0, 60.0, 0.9)], [box(3), box(51)]]
    flat = [r for part in rows for r in part]
    folder = files_of(spark, tmp_path, flat, BOXES, 4, lambda r: next(i for i, p in enumerate(rows) if r in p))
    got = {r[:2]: r[3] for r in moved(spark, folder, 1, tmp_path / "out", BOXES, memory=10, late=10)}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 50): 2, ("a", 49): None, ("b", 50): 1, ("a", 51): 2}


def test_covariances_are_guarded():
    root = motion.factored(np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert np.allclose(root @ root.T, [[1, 1], [1, 1]], atol=1e-4)
    with pytest.raises(np.linalg.LinAlgError):
        motion.factored(np.array([[1.0, 9.0], [9.0, 1.0]]))
    box = np.array([0.0, 0.0, 20.0, 40.0])
    f = motion.Filter.of(0, box, None)
    for i in range(1, 30):
        f.update(i, box + 2 * i, None)
    assert np.allclose(f.box(34), box + 68, atol=0.5) and np.linalg.eigvalsh(f.cov).min() > 0


def test_pairs_of_two_streams(spark, tmp_path):
    """Pairs come out, lone boxes when the watermark has passed them; a row behind the watermark is dropped."""
    schema = "clip string, frame long, tid long, x1 double, y1 double, x2 double, y2 double, conf double"
    box = lambda f, t, x=0.0: ("a", f, t, x, 0.0, x + 20, 40.0, 0.9)
    parts = {"truth": [[box(0, 1), box(0, 2, 500.0), box(1, 1)], [box(60, 1)], [box(62, 3)], [box(2, 9), box(200, 1)]], "pred": [[box(0, 11), box(0, 12, 900.0)], [box(1, 11), box(60, 11)], [box(61, 11)], [box(200, 11)]]}
    streams = {}
    for name, pieces in parts.items():
        (tmp_path / name).mkdir()
        flat = [r for p in pieces for r in p]
        folder = files_of(spark, tmp_path / name, flat, schema, 4, lambda r, pieces=pieces: next(i for i, p in enumerate(pieces) if r in p))
        streams[name] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = live.drained(live.matched_stream(streams["pred"], streams["truth"], 0.5, 10), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    got = sorted((r.frame, r.o or 0, r.p or 0) for r in out)
    # Frame 1 of the prediction comes with frame 60, before the watermark moves; frame 2 of the truth comes after it (late rows go by the watermark of the batch before the last).
    assert got == [(0, 0, 12), (0, 1, 11), (0, 2, 0), (1, 1, 11), (60, 1, 11), (61, 0, 11), (62, 3, 0), (200, 1, 11)]
