"""Graphs that are tables of edges: connected components, and greedy one-to-one matching without an order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.sources.store import stored


#: Edges that a task contracts at a time.
CHUNK = 100_000


def _order(node: Any) -> Any:
    """A node as Python sorts it where Spark sorts it the same way: nulls first, fields of a struct one after the other."""
    return tuple((v is not None, v) for v in node.values()) if isinstance(node, dict) else (node is not None, node)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, b the least node of what a task sees of its component: fewer edges and shorter ways, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[Any, Any] = {}
        nodes: dict[Any, Any] = {}
        types = None

        def root(x: Any) -> Any:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def stars() -> pa.RecordBatch:
            found = [(nodes[x], nodes[root(x)]) for x in parent if root(x) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], types[i]) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            types = [f.type for f in batch.schema]
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = _order(u), _order(v)
                for k, n in ((x, u), (y, v)):
                    if k not in parent:
                        parent[k], nodes[k] = k, n
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            if len(parent) >= CHUNK:
                yield stars()
                nodes.clear()
        if parent:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or the other way round."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    seen = ends.groupBy("x.n").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): component is the smallest node reachable over ``edges`` (a, b), loops ignored. Nodes are of any type with an order.

    Tasks contract what they hold; then large-star and small-star steps alternate with that until only stars are left, which takes a
    logarithmic number of rounds and keeps the number of edges linear. The smallest neighbour is a grouped minimum,
    added up before the shuffle, so the centre of a large star is not gathered in one task. Every round is written
    to the shared folder, which cuts lineage.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    e = stored(contracted(edges.where("a <> b")), name)
    while not _are_stars(e):
        # Large star: larger neighbours of u are linked to the least of u and its neighbours.
        sym = e.select(F.explode(both).alias("x")).select("x.u", "x.v")
        # Dealt out anew, so that both sides of the join come from shuffles and Spark can split the rows of a star's centre.
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).repartition("u", "m")
        e = sym.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u (the larger end) and its smaller neighbours are linked to the least of these.
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = stored(contracted(small.where("a <> b").distinct()), name)
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def matched(edges: DataFrame, left: list[str], right: list[str], rank: str, name: str = "matched") -> DataFrame:
    """The edges that one-to-one greedy matching takes, least ``rank`` first; no two edges that share an end have the same rank.

    An edge that comes first at both its ends is taken whatever happens elsewhere, and every other edge at these ends is
    out. So all such edges are taken at once, and what is left is looked at again: the result is that of going through
    all edges in order, without an order over the whole table. The first edge of all is always taken, so rounds end;
    the edges that are left fall fast. Each round is written to the shared folder.
    """
    at_left, at_right = Window.partitionBy(*left), Window.partitionBy(*right)
    open_, taken = edges, None
    while True:
        first = open_.withColumn("_l", F.min(rank).over(at_left)).withColumn("_r", F.min(rank).over(at_right))
        first = first.withColumn("_taken", (F.col(rank) == F.col("_l")) & (F.col(rank) == F.col("_r"))).drop("_l", "_r")
        out = first.withColumn("_out", F.max("_taken").over(at_right)).withColumn("_out", F.col("_out") | F.max("_taken").over(at_left))
        round_ = stored(out, name)
        new = round_.where("_taken").select(*edges.columns)
        taken = new if taken is None else taken.unionByName(new)
        open_ = round_.where("not _out").select(*edges.columns)
        if open_.isEmpty():
            return taken
