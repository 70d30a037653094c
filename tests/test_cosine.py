"""The cosine of embeddings covers every labelled vector, not only those of near ids."""

import random

from trackloom.plans import catalog


def test_every_vector_meets_its_mean(spark, sf):
    got = {r.vec_id: r for r in catalog.QUERIES["cosine_to_mean"](spark, sf).collect()}
    assert set(got) == {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("label is not null").collect()}
    assert all(-1 <= r.cos <= 1 for r in got.values())


def test_search_in_blocks(spark, monkeypatch):
    """Blocks of a few vectors, copies, ties to six places, vectors that are null, short or not finite: as all pairs row by row have it."""
    from pyspark.sql import functions as F

    from trackloom.functions import geometry as g
    from trackloom.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(120)]
    rows += [(200 + i, "x", list(rows[0][2])) for i in range(20)] + [(301, "x", None), (302, "y", [1.0]), (303, "z", [float("nan"), 1.0, 0.0]), (305, "z", [1.0, None, 0.0]), (306, None, [1.0, 0.0, 0.0]), (40, "x", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, label string, e array<double>")
    got = {r.a: (r.b, r.cos, r.compared) for r in nearest.nearest(df, F.col("id") % 5 == 0).collect()}
    pairs = df.where("id % 5 = 0").select("label", F.col("id").alias("a"), F.col("e").alias("ea")).join(df.select("label", F.col("id").alias("b"), F.col("e").alias("eb")), "label").where("a <> b")
    want = pairs.withColumn("cos", F.round(g.cosine(F.col("ea"), F.col("eb")), 6)).groupBy("a").agg(F.min_by("b", F.struct(F.col("cos").isNull(), -F.col("cos"), "b")).alias("b"), F.max("cos").alias("cos"), F.count("*").alias("compared"))
    want = {r.a: (r.b, r.cos, r.compared) for r in want.collect()}
    assert len(got) > 20 and {a: str(r) for a, r in got.items()} == {a: str(r) for a, r in want.items()}  # as text, as NaN is not equal to itself


def test_search_makes_no_pairs_of_plain_rows(spark, sf):
    """A plan with a join of the vectors of a label, one pair a row, took time with the square of the table for each core."""
    df = catalog.QUERIES["cosine_pairs"](spark, sf)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
