"""Planted faults are counted as planted, mended by the chain, and the same at any partitioning; runs leave records."""

import json

import pytest

from trackloom.operators import score
from trackloom.plans import pipeline, record
from trackloom.sources import synthetic


@pytest.fixture(scope="module")
def tables(spark):
    return synthetic.truth(spark).cache(), synthetic.detections(spark).cache()


def faults(pred, truth):
    return {r.clip: {"misses": r.misses, "switches": r.switches, "false_positives": r.false_positives} for r in score.clip_metrics(pred, truth).collect()}


def test_faults_are_as_planted(spark, tables):
    truth, found = tables
    assert faults(found, truth) == {c: synthetic.planted() for c in ("g0", "g1")}
    assert faults(truth, truth) == {c: dict.fromkeys(synthetic.planted(), 0) for c in ("g0", "g1")}


def test_the_chain_mends_them(spark, tables, tmp_path):
    truth, found = tables
    root = f"file://{tmp_path}"
    tracks = record.recorded_tracks(found, pipeline.Config(), root)
    assert faults(tracks, truth) == {c: dict.fromkeys(synthetic.planted(), 0) for c in ("g0", "g1")}
    got = record.records(spark, root).collect()
    kept = [name for _, _, name in pipeline.CHAIN if name] + ["tracks"]
    assert sorted((r.stage, r.clip) for r in got) == sorted((s, c) for s in kept for c in ("g0", "g1"))
    last = {r.clip: (r.tracks, r.boxes) for r in got if r.stage == "tracks"}
    assert last == {c: (6, 720) for c in ("g0", "g1")} and all(json.loads(r.knobs)["min_total"] == 20 and r.seconds > 0 for r in got)
    record.recorded_tracks(found, pipeline.Config(), root)
    assert record.records(spark, root).select("run").distinct().count() == 2


def test_the_same_at_any_partitioning(spark):
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        rows.append(sorted(map(tuple, synthetic.detections(spark, 3, 5, 60, 4).collect())))
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert rows[0] == rows[1] and len({r[0] for r in rows[0]}) == 3
    other = sorted(map(tuple, synthetic.detections(spark, 3, 5, 60, 5).collect()))
    assert other != rows[0] and [r for r in rows[0] if r[0] != "g2"] == sorted(map(tuple, synthetic.detections(spark, 2, 5, 60, 4).collect()))
