"""Sketches against exact counts and quantiles, and parts against the whole."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import sketch

KEYS = ["clip", "day"]


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(3)}", rng.randrange(4), rng.randrange(5000), rng.random() ** 2) for _ in range(30_000)]
    return spark.createDataFrame(rows, "clip string, day int, tid long, conf double"), rows


def close(row, mine):
    conf = sorted(r[3] for r in mine)
    rank = lambda v: sum(c <= v for c in conf) / len(conf)
    assert row.boxes == len(mine) and abs(row.ids / len({r[2] for r in mine}) - 1) < 0.06
    assert abs(rank(row.conf_p50) - 0.5) < 0.03 and abs(rank(row.conf_p90) - 0.9) < 0.03


def test_errors_and_roll_ups(spark, boxes):
    df, rows = boxes
    got = sketch.rolled_up(sketch.sketches(df, KEYS), KEYS).collect()
    assert len(got) == 3 * 4 + 3 + 4 + 1
    for r in got:
        close(r, [x for x in rows if (r.level & 2 or x[0] == r.clip) and (r.level & 1 or x[1] == r.day)])


def test_parts_make_the_whole(spark, boxes):
    df, rows = boxes
    part = F.pmod(F.xxhash64("tid", "conf"), F.lit(3))
    kept = sketch.sketches(df.where(part == 0), KEYS)
    for k in (1, 2):
        kept = sketch.added(kept, sketch.sketches(df.where(part == k), KEYS), KEYS)
    whole = {(r.clip, r.day): (r.boxes, r.ids) for r in sketch.rolled_up(sketch.sketches(df, KEYS), KEYS).collect() if r.level == 0}
    for r in sketch.rolled_up(kept, KEYS).collect():
        if r.level == 0:
            assert whole[r.clip, r.day][0] == r.boxes and abs(whole[r.clip, r.day][1] / r.ids - 1) < 0.03
            close(r, [x for x in rows if x[:2] == (r.clip, r.day)])
    again = sketch.added(kept, kept, KEYS)  # the same boxes twice are twice as many, of no more ids
    twice = {(r.clip, r.day): (r.boxes, r.ids) for r in sketch.rolled_up(again, KEYS).collect() if r.level == 0}
    assert all(twice[k][0] == 2 * n and abs(twice[k][1] / i - 1) < 0.03 for k, (n, i) in whole.items())


def test_nulls_and_nothing(spark):
    schema = "clip string, day int, tid long, conf double"
    none = spark.createDataFrame([], schema)
    assert sketch.sketches(none, KEYS).count() == 0
    (r,) = sketch.rolled_up(sketch.sketches(spark.createDataFrame([(None, 1, 7, 0.5), (None, 1, 7, None)], schema), KEYS), KEYS).where("level = 0").collect()
    assert (r.clip, r.boxes, r.ids, r.conf_p50) == (None, 2, 1, 0.5)
