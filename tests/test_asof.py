"""As-of joins against a plain search; what fails is set aside."""

import random

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trackloom.operators import asof, guard


@pytest.mark.parametrize("strictly", [False, True])
def test_last_earlier_row(spark, strictly):
    rng = random.Random(5)
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-30, 60)]), i) for i in range(300)] + [("hot", t, 1000 + t) for t in range(200)]
    right = list({(k, t): (k, t, rng.random()) for k, t in [(rng.choice(["a", "b", None, "z"]), rng.randrange(-40, 70)) for _ in range(60)] + [("hot", 3)]}.values()) + [("a", None, 9.0)]
    a = spark.createDataFrame(left, "k string, t long, i long")
    b = spark.createDataFrame(right, "k string, t long, v double").withColumn("seen", F.col("t"))
    want = {}
    for k, t, i in left:
        fit = [(u, v) for key, u, v in right if key == k and t is not None and u is not None and (u < t if strictly else u <= t)]
        want[i] = (k, t, *(reversed(max(fit)) if fit else (None, None)))
    for width in (1, 7, 1000):
        got = {r.i: (r.k, r.t, r.v, r.seen) for r in asof.asof_join(a, b, ["k"], "t", width, strictly).collect()}
        assert got == want
    assert asof.asof_join(a.limit(0), b, ["k"], "t", 5).count() == 0
    assert asof.asof_join(a, b.limit(0), ["k"], "t", 5).where("v is not null").count() == 0


def test_failing_groups_give_an_error_row(spark):
    df = spark.createDataFrame([(c, t, float(t)) for c in "abc" for t in range(4)], "clip string, tid long, v double")

    def run(pdf):
        if pdf["clip"].iloc[0] == "b" and pdf["tid"].iloc[0] == 2:
            raise ValueError("planted")
        return pd.DataFrame({"clip": pdf["clip"], "v": pdf["v"] * 2})

    rows, errors = guard.guarded_groups(df, ["clip", "tid"], run, "clip string, v double", "double")
    assert sorted(map(tuple, rows.collect())) == sorted((c, 2.0 * t) for c in "abc" for t in range(4) if (c, t) != ("b", 2))
    assert [tuple(r) for r in errors.collect()] == [("b", 2, "double", "ValueError: planted")]


def test_failing_clips_lose_nothing_else(spark):
    df = spark.createDataFrame([(f"c{i}", f, "7" if (i, f) not in ((3, 1), (11, 0)) else "x") for i in range(16) for f in range(3)], "clip string, frame long, raw string")
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    build = lambda d: d.select("clip", "frame", F.when(F.col("raw") == "x", F.raise_error(F.lit("planted"))).otherwise(F.lit(7)).alias("n"))
    rows, errors = guard.build_or_set_aside(df, build, "read")
    assert {(r.clip, r.frame) for r in rows.collect()} == {(f"c{i}", f) for i in range(16) for f in range(3) if i not in (3, 11)}
    got = errors.collect()
    assert sorted(r.clip for r in got) == ["c11", "c3"] and all(r.stage == "read" and "planted" in r.error for r in got)
    before = jobs()
    rows, errors = guard.build_or_set_aside(df.where("raw <> 'x'"), build, "read")
    assert jobs() - before <= 2 and errors.isEmpty() and rows.count() == 46
    with pytest.raises(AnalysisException):
        guard.build_or_set_aside(df, lambda d: d.select("nowhere"), "read")
    rows, errors = guard.build_or_set_aside(df.limit(0), build, "read")
    assert rows.count() == 0 and errors.count() == 0
