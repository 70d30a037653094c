"""Nearest vectors by cosine: blocks of queries meet blocks of vectors, a matrix product for each pair of blocks."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as g

#: Vectors of a block, and queries of one that are multiplied at a time: what a task holds, whatever the size of the table.
BLOCK, AT_ONCE = 8192, 256
#: How far a product summed in another order may lie from the one in order.
SLACK = 1e-9


def six(x: float) -> float:
    """To six places as Spark rounds."""
    return float(Decimal(repr(float(x))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first place to the last."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        s = s + x[:, k] * y[:, k]
    return s


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_in_order(x, x)) + 1e-9


def best_of_block(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(a, b, cos, compared): for each query the vector of another id with the largest cosine to six places, then the least id."""
    order = np.argsort(b, kind="stable")
    b, y = b[order], y[order]
    nx, ny = _norms(x), _norms(y)
    out = []
    for at in range(0, len(a), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        near = (x[part] @ y.T) / (nx[part, None] * ny[None])
        own = a[part, None] == b[None]
        near[own] = -np.inf
        compared = len(b) - own.sum(axis=1)
        top = near.max(axis=1)
        # All that could be the best to six places are worked out again in order.
        i, j = np.nonzero(near >= top[:, None] - 1e-6 - 2 * SLACK)
        cos = _in_order(x[part][i], y[j]) / (nx[part][i] * ny[j])
        starts = np.searchsorted(i, np.arange(len(top) + 1))
        for q in np.flatnonzero(compared):
            c, ids = cos[starts[q] : starts[q + 1]], b[j[starts[q] : starts[q + 1]]]
            best = six(c.max())
            first = next(k for k in np.flatnonzero(c >= best - 5e-7 - 1e-12) if c[k] >= best - 5e-7 + 1e-12 or six(c[k]) == best)
            out.append((int(a[part][q]), int(ids[first]), best, int(compared[q])))
    return out


def _table(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block (label, id, e, ...)."""
    e = t.column(2).combine_chunks()
    return t.column(1).to_numpy(), e.flatten().to_numpy(zero_copy_only=False).reshape(len(e), -1)


def nearest(v: DataFrame, asks: Column) -> DataFrame:
    """(a, b, cos, compared) for the rows of ``v`` (id, label, e: array of doubles) where ``asks`` holds: the nearest of all rows of the label with another id.

    Every query meets every row of its label. Both are dealt into blocks by id and each pair of blocks is a group, so no task holds a label;
    a block gives a row for each query. Vectors that are null, of another length or not finite are compared row by row; a cosine that is null comes last.
    """
    n = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = v.where("id is not null and label is not null").withColumn("_asks", F.coalesce(asks, F.lit(False)))
    sizes = v.groupBy("label").agg(F.count("*").alias("_n"), F.sum(F.col("_asks").cast("long")).alias("_q"), F.max(F.size("e")).alias("_dim"))
    plain = (F.size("e") == F.col("_dim")) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.join(sizes, "label").withColumn("_plain", F.coalesce(plain, F.lit(False)) & (F.col("_dim") > 0))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    mine = lambda c: F.pmod(F.xxhash64("id"), F.greatest(blocks(c), F.lit(1)))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(blocks(c), F.lit(1)) - 1))
    keys = lambda p: [f"{p}_label", f"{p}_i", f"{p}_j"]
    # What a pair of blocks costs is not in its bytes, so blocks are spread over all partitions however small they are.
    queries = v.where("_plain and _asks").select(F.col("label").alias("q_label"), F.col("id").alias("q_id"), F.col("e").alias("q_e"), mine("_q").alias("q_i"), every("_n").alias("q_j")).repartition(n, *keys("q"))
    rows = v.where("_plain and _q > 0").select(F.col("label").alias("r_label"), F.col("id").alias("r_id"), F.col("e").alias("r_e"), mine("_n").alias("r_j"), every("_q").alias("r_i")).repartition(n, *keys("r"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = best_of_block(*_table(left), *_table(right)) if left.num_rows and right.num_rows else []
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table({c: pa.array([r[k] for r in found], t) for k, (c, t) in enumerate(zip(("a", "b", "cos", "compared"), types, strict=True))})

    found = queries.groupBy(*keys("q")).cogroup(rows.groupBy(*keys("r"))).applyInArrow(run, "a long, b long, cos double, compared long")
    left = v.where("_asks").select("label", F.col("id").alias("a"), F.col("e").alias("ea"), F.col("_plain").alias("pa"))
    right = v.select("label", F.col("id").alias("b"), F.col("e").alias("eb"), F.col("_plain").alias("pb"))
    # An equality on what is odd for each side, so that plain pairs are never made.
    odd = left.where("not pa").join(right, "label").unionByName(left.where("pa").join(right.where("not pb"), "label")).where("a <> b")
    odd = odd.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round(g.cosine(F.col("ea"), F.col("eb")), 6).alias("cos"), F.lit(1).cast("long").alias("compared"))
    both = found.unionByName(odd)
    return both.groupBy("a").agg(F.min_by("b", F.struct(F.col("cos").isNull(), -F.col("cos"), "b")).alias("b"), F.max("cos").alias("cos"), F.sum("compared").alias("compared"))
