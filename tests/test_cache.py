"""Tables that are found again, clip by clip."""

import pytest
from pyspark.sql import functions as F

from trackloom.sources import cache

BOXES = "clip string, frame long, conf double"


def test_only_what_changed_is_built(spark, tmp_path):
    root, built = f"file://{tmp_path}/cache", []

    def build(df):
        built.append(sorted(r.clip for r in df.select("clip").distinct().collect()))
        return df.where("conf > 0.5").select("clip", F.col("frame").alias("f"))

    rows = [(c, f, 0.2 + 0.1 * f) for c in ("a", "b", "c") for f in range(6)] + [("none", 1, 0.1)]
    want = lambda rows: sorted((c, f) for c, f, p in rows if p > 0.5)
    read = lambda rows, config="x", parts=3: sorted(map(tuple, cache.scan_or_build(spark.createDataFrame(rows, BOXES).repartition(parts), build, config, root).collect()))
    assert read(rows) == want(rows) and built == [["a", "b", "c", "none"]]
    assert read(rows[::-1], parts=5) == want(rows) and len(built) == 1  # order and partitioning don't matter, an empty result is one
    changed = [r if r[:2] != ("b", 3) else ("b", 3, 0.1) for r in rows] + [("d", 0, 0.9)]
    assert read(changed) == want(changed) and built[1:] == [["b", "d"]]
    assert read(rows) == want(rows) and len(built) == 2  # what was built before is still there
    assert read(rows, "y") == want(rows) and built[2:] == [["a", "b", "c", "none"]]
    assert read([*rows, rows[0]]) == want([*rows, rows[0]]) and built[3:] == [["a"]]  # a repeated row is another table


def test_a_failed_build_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.5)], BOXES)
    broken = lambda d: d.withColumn("frame", F.when(F.col("clip") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("frame")))
    with pytest.raises(Exception, match="broken"):
        cache.scan_or_build(df, broken, "x", root)
    assert cache.manifest(spark, root).isEmpty()
    assert cache.scan_or_build(df, lambda d: d, "x", root).count() == 2
    assert cache.scan_or_build(df.limit(0), lambda d: d, "x", root).count() == 0
