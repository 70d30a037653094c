"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.store import stored


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): component is the smallest node reachable over ``edges`` (a, b), loops ignored.

    Alternates large-star and small-star steps, which end after a logarithmic number of rounds and
    keep the number of edges linear. The smallest neighbour is a grouped minimum, added up before
    the shuffle, so the centre of a large star is not gathered in one task. Every round is written
    to the shared folder, which cuts lineage.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, name)
    before = None
    while True:
        # Large star: larger neighbours of u are linked to the least of u and its neighbours.
        sym = e.select(F.explode(both).alias("x")).select("x.u", "x.v")
        # Dealt out anew, so that both sides of the join come from shuffles and Spark can split the rows of a star's centre.
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).repartition("u", "m")
        e = sym.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u (the larger end) and its smaller neighbours are linked to the least of these.
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = stored(small.where("a <> b").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    stars = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
