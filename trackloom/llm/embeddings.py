"""Operator 4: near duplicates among embeddings.

Vectors with the same label are hashed by the signs of random hyperplanes, in several tables. Inside
a bucket all pairs are verified by the exact cosine in double precision, block against block; a pair
is counted in the first table where its signs agree, so nothing is counted twice. Bits for a table
follow from the largest label (buckets keep their size as the input grows), the number of tables
from the bits and the chance ``miss`` of losing a pair just at the threshold.

Identical vectors are one class before hashing: a vector that a third of all rows share is one row.
Links of classes are weighted by their sizes.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and vectors
without label or vec_id link with nothing, and neither do vectors of different lengths; rows that share a
vec_id are copies or stay separate vectors with that id; a cosine right at the threshold links; other columns
may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.blocks import in_pieces
from trackloom.llm.components import connected_components
from trackloom.llm.store import stored

BUCKET = 64
BLOCK_ROWS = 1024


def shape(largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(48, max(2, math.ceil(math.log2(max(largest, 1) / BUCKET))))
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-(agree**bits))))


def hyperplanes(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Signs of each vector as an integer a table, in as few bytes as hold them."""
    signs = (x @ hyperplanes(seed, x.shape[1], bits * tables) >= 0).reshape(len(x), tables, bits)
    return (signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))).astype(sig_type(bits))


def sig_type(bits: int) -> np.dtype:
    return np.dtype("<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<i8")


def unit(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def component_type(vectors: DataFrame) -> str:
    """How components are kept: floats as floats, anything else as doubles, so nothing is lost."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec (bytes of the components) of every usable vector."""
    kind = component_type(vectors)
    e = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("e", e).where((F.size("e") > 0) & ~bad & F.exists("e", lambda v: v != 0))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            flat, at = (col.flatten().to_numpy(zero_copy_only=False) + 0.0).astype(kind), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            raw = [flat[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["vec_id", "label", "vec"])

    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "e").mapInArrow(packed, "vec_id long, label string, vec binary")
    return rows


def near_vectors(vectors: DataFrame, threshold: float = 0.93, miss: float = 0.002, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    rows, kind = stored(usable(vectors), "vec-rows"), component_type(vectors)
    # A class is known by a number that it gets when the table is written: several may share a vec_id as their smallest.
    classes = rows.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vec-classes")
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    bits, tables = shape(largest, threshold, miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("vec").to_pylist()
            sig = np.zeros((len(raw), tables), sig_type(bits))
            for n in {len(r) for r in raw}:
                at = [i for i, r in enumerate(raw) if len(r) == n]
                sig[at] = signatures(unit([raw[i] for i in at], kind), bits, tables, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in sig], pa.binary())], names=[*b.schema.names, "sig"])

    hashes = nodes.select("node", "cnt", "label", "vec").mapInArrow(hashed, "node long, cnt long, label string, vec binary, sig binary")
    hashes = stored(hashes, "vec-hashes")
    # Buckets are made and cut of ids alone; vectors and signatures join what is left to compare.
    width = sig_type(bits).itemsize
    at = F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))
    members = hashes.select("node", "label", F.length("vec").alias("dim"), "sig", at.alias("t")).select("node", "dim", "t", F.xxhash64("label", "dim", "t", F.substring("sig", F.col("t") * width + 1, F.lit(width))).alias("bucket"))
    pieces = in_pieces(members, ["bucket", "t", "dim"], "node", BLOCK_ROWS, name="vec-sizes")
    pieces = pieces.join(hashes.select("node", "label", "cnt", "vec", "sig"), "node")

    def linked(cell: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in cell.groupby(["bucket", "t", "dim", "i", "j"], sort=False):
            both = len(set(g["side"])) > 1
            a = g[g["side"] == 0] if both else g
            b = g[g["side"] == 1] if both else g
            if not both and (len(g) < 2 or g["side"].iloc[0] != 2):  # one of the two blocks has no members
                continue
            t = int(g["t"].iloc[0])
            x, y = unit(list(a["vec"]), kind), unit(list(b["vec"]), kind)
            i, j = np.nonzero(np.clip(x @ y.T, -1, 1) >= threshold)
            keep = a["label"].to_numpy()[i] == b["label"].to_numpy()[j]
            if not both:
                keep &= i < j
            i, j = i[keep], j[keep]
            if t:
                sa, sb = (np.frombuffer(b"".join(v["sig"]), sig_type(bits)).reshape(len(v), tables)[:, :t] for v in (a, b))
                step = max(1, (1 << 20) // t)
                first = np.concatenate([~(sa[i[k : k + step]] == sb[j[k : k + step]]).any(axis=1) for k in range(0, len(i), step)] or [np.zeros(0, bool)])
                i, j = i[first], j[first]
            out.append(linked_members(i, j, a["node"].to_numpy(), b["node"].to_numpy(), a["cnt"].to_numpy(), b["cnt"].to_numpy()))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []})

    links = pieces.groupBy("cell").applyInPandas(linked, "node long, links long, root long")
    links = stored(links, "vec-links")
    return per_row(vectors, rows, nodes, links)


def linked_members(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> pd.DataFrame:
    """Node, weighted links and local component of all members with a link; pairs (a[i], b[j])."""
    ids, inverse = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    u, v = inverse[: len(i)], inverse[len(i) :]
    links = np.bincount(u, cb[j], len(ids)) + np.bincount(v, ca[i], len(ids))
    root = np.arange(len(ids))
    while True:  # labels shrink to the least of each component
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"node": ids, "links": links.astype(np.int64), "root": ids[root]})


def per_row(vectors: DataFrame, rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = links.groupBy("node").agg(F.sum("links").alias("links"))
    comp = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "vec-components")
    named = comp.join(nodes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    comp = comp.join(least, "component").select("node", "component_id")
    per_class = nodes.join(found, "node", "left").join(comp, "node", "left").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component_id"))
    own = rows.join(per_class, ["label", "vec"]).select("vec_id", "links", "component_id")
    # Rows that can't link are what the usable ones leave; ids tell them apart, and where an id repeats its most linked row speaks for it.
    own = own.groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(own, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
