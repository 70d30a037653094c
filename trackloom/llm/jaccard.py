"""Operator 7: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. A pass over the texts gives each document a fingerprint of its words, its number of shingles and
   a MinHash signature. Documents with the same words are one class and go on as one row.
2. Classes that share a band of the signature are candidates; their components are found without
   making pairs.
3. Inside a component MinHash values are compared some at a time. A pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold falls below
   ``TOLERANCE``; what is left is verified on the whole shingle sets. Large components are cut into
   blocks and every pair of blocks is a piece of work of bounded size.

A row is made for a class, never for a pair, so a group of copies costs its size in rows.

Defined cases: a document of fewer than five words, but not none, has one shingle of all its words;
one without words (or with a null text) links with nothing and is kept. Rows have a key of their own, made
of id and text, so different texts may share an id and null ids take part (they come last). Each row
gets a row of the result, and exactly one row of a component is kept, however often it is repeated; of texts that
share the smallest id one stays. A similarity right at the threshold links. A text of any length is one text; other
columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.blocks import in_pieces
from trackloom.llm.components import connected_components
from trackloom.llm.embeddings import linked_members
from trackloom.llm.filters import joined, without
from trackloom.llm.memory import give_back, tidy
from trackloom.llm.store import stored
from trackloom.llm.text import chunks, mixed, sequence_keys, shingles, words

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
ROUND = 15
TOLERANCE = 1e-6
BLOCK_ROWS = 512
BLOCK_SHINGLES = 400_000
_MULTIPLIERS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def fewest_matches(threshold: float = float(THRESHOLD), tolerance: float = TOLERANCE) -> list[int]:
    """After each round, the least matches with which a pair stays.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), and the chance
    that it is above t is the chance of at most m successes among n + 1 trials of probability t.
    """
    least = []
    for n in range(ROUND, HASHES + 1, ROUND):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        least.append(m)
    return least


_FEWEST = fewest_matches()


def minhash(sh: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signatures of the rows with shingles; rows without are left out."""
    starts = np.concatenate([[0], np.cumsum(counts[counts > 0])])[:-1].astype(np.int64)
    out = np.empty((len(starts), HASHES), np.uint32)
    for k, a in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat(((sh * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def own_key():
    """Identity of a row: its id and a hash of id and text, so that rows of different ids never share it."""
    i = F.col("doc_id").cast("long")
    return F.struct(F.coalesce(i, F.lit(-(2**63))).alias("i"), F.xxhash64(F.lit(7), i, F.col("text").cast("string")).alias("h")).alias("u")


def signed(docs: DataFrame) -> DataFrame:
    """u (key of id and text), doc_id, k1, k2 (fingerprint of the words), n (shingles), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in chunks(b.column(2)):
                found, n_words = words(data, offsets)
                k1, k2 = sequence_keys(found, n_words)
                sh, n = shingles(found, n_words, SHINGLE)
                sigs = iter(minhash(sh, n)) if len(sh) else iter(())
                sig = [next(sigs).tobytes() if x else None for x in n]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(first, last - first) for i in (0, 1)], pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n), pa.array(sig, pa.binary())], names=["u", "doc_id", "k1", "k2", "n", "sig"])

    rows = docs.select(own_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "u struct<i: long, h: long>, doc_id long, k1 long, k2 long, n long, sig binary")


def with_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (u, node, k1, k2, copies, ...) with ``sh``, the sorted distinct shingles of its text; a row for each, however many copies there are."""
    texts = docs.select(own_key(), F.col("text").cast("string").alias("text"))
    rows = joined(texts, wanted, "u").select("text", *wanted.columns)
    names = wanted.columns
    at = {c: i + 1 for i, c in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in chunks(b.column(0)):
                found, n_words = words(data, offsets)
                k1, k2 = sequence_keys(found, n_words)
                sh, n = shingles(found, n_words, SHINGLE)
                ends = np.concatenate([[0], np.cumsum(n)])
                part = b.slice(first, last - first)
                own = (part.column(at["k1"]).to_numpy() == k1.view(np.int64)) & (part.column(at["k2"]).to_numpy() == k2.view(np.int64))
                sets = [np.unique(sh[i:j]).tobytes() if ok else None for i, j, ok in zip(ends, ends[1:], own, strict=False)]
                out = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.binary())], names=[*names, "sh"])
                yield out.filter(pa.array(own))

    schema = ", ".join(f"{c} {t}" for c, t in wanted.dtypes) + ", sh binary"
    out = stored(rows.mapInArrow(tidy(run), schema), "jaccard-members")
    return out.where("copies = 1").unionByName(out.where("copies > 1").dropDuplicates(["node"]))


def candidates(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose posterior stays above the tolerance in every round."""
    matches = np.zeros((len(a), len(b)), np.uint8)
    for k in range(ROUND):
        matches += a[:, k, None] == b[None, :, k]
    keep = matches >= _FEWEST[0]
    if same:
        keep &= np.tri(len(a), k=-1, dtype=bool).T
    i, j = np.nonzero(keep)
    found = matches[i, j].astype(np.int16)
    for r in range(1, HASHES // ROUND):
        if not len(i):
            break
        cols = slice(r * ROUND, (r + 1) * ROUND)
        step = 1 << 16
        more = [(a[i[k : k + step], cols] == b[j[k : k + step], cols]).sum(axis=1) for k in range(0, len(i), step)]
        found = found + np.concatenate(more).astype(np.int16)
        alive = found >= _FEWEST[r]
        i, j, found = i[alive], j[alive], found[alive]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether the shingle sets of each pair reach the threshold, in whole numbers."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(i) <= 2 * (len(a) + len(b)):
        common = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:
        _, codes = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        shared = np.bincount(codes) > 1
        place = np.cumsum(shared) - 1
        codes = np.where(shared[codes], place[codes], -1)
        row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
        row, codes = row[codes >= 0], codes[codes >= 0]
        order = np.argsort(codes, kind="stable")
        row, codes = row[order], codes[order]
        total = np.zeros((len(a), len(b)), np.float32)
        width = 2048
        for c in range(0, int(shared.sum()), width):
            lo, hi = np.searchsorted(codes, [c, c + width])
            block = np.zeros((len(a) + len(b), width), np.float32)
            block[row[lo:hi], codes[lo:hi] - c] = 1
            total += block[: len(a)] @ block[len(a) :].T
        common = np.rint(total[i, j]).astype(np.int64)
    union = na[i] + nb[j] - common
    return common * THRESHOLD.denominator >= union * THRESHOLD.numerator


def links_in(cell: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, g in cell.groupby(["grp", "i", "j"], sort=False):
        sides = set(g["side"])
        if sides not in ({2}, {0, 1}) or len(g) < 2:  # one of the two blocks has no members
            continue
        parts = [g] if sides == {2} else [g[g["side"] == 0], g[g["side"] == 1]]
        sig = [np.frombuffer(b"".join(p["sig"]), np.uint32).reshape(len(p), HASHES) for p in parts]
        i, j = candidates(sig[0], sig[-1], len(parts) == 1)
        if not len(i):
            continue
        sets = [[np.frombuffer(x, np.uint64) for x in p["sh"]] for p in parts]
        ok = verified(i, j, sets[0], sets[-1])
        reps, cnts = [p["node"].to_numpy() for p in parts], [p["cnt"].to_numpy() for p in parts]
        if ok.any():
            out.append(linked_members(i[ok], j[ok], reps[0], reps[-1], cnts[0], cnts[-1]))
    give_back()
    return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []})


def linked_rows(docs: DataFrame) -> DataFrame:
    """A row for each distinct id and text: u, doc_id, copies (rows of it), class_id, n_links, component_id, one (whether one of the rows is kept) and alone (no words, all are kept)."""
    rows = stored(signed(docs), "jaccard-rows")
    own = stored(rows.groupBy("u", "doc_id", "k1", "k2", "n").agg(F.count("*").alias("copies")), "jaccard-own")
    # The least id speaks for a class; a class is known by its words, not by an id that others may share.
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "u")
    # Documents without words are classes of their own.
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min(least).alias("rep"), F.count("*").alias("cnt"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # A class is known by a number that it gets when the table is written; no two share one.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + 4 * ROWS * k, 4 * ROWS)) for k in range(BANDS)])
    keys = classes.select("node", F.explode(bands).alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("c")).where("c > 1").select("band", "least")
    edges = keys.join(shared, "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = stored(connected_components(edges, "jaccard-candidates"), "jaccard-groups")
    wanted = classes.join(groups, "node").select(F.col("rep.u").alias("u"), "node", "k1", "k2", "cnt", "n", "sig", F.col("component").alias("grp"))
    wanted = wanted.join(own.where("copies > 1").select("u", "copies"), "u", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    members = with_shingles(docs, wanted)
    pieces = in_pieces(members, ["grp"], "node", BLOCK_ROWS, "n", BLOCK_SHINGLES, "jaccard-sizes").select("cell", "grp", "i", "j", "side", "node", "cnt", "sig", "sh")
    links = stored(pieces.groupBy("cell").applyInPandas(links_in, "node long, links long, root long"), "jaccard-links")
    found = links.groupBy("node").agg(F.sum("links").alias("links"))
    comp = stored(connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-components"), "jaccard-nodes")
    first = stored(comp.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("first")), "jaccard-first")
    comp = comp.join(first, "component").select("node", "first")
    per_class = classes.select("node", "k1", "k2", "rep", "cnt").join(found, "node", "left").join(comp, "node", "left")
    per_class = per_class.select("k1", "k2", "rep", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("links"), F.coalesce("first", "rep").alias("first"))
    out = own.join(per_class, ["k1", "k2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "u", "doc_id", "copies", F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (alone | (F.col("u") == F.col("first.u"))).alias("one"), alone.alias("alone"),
    )


def jaccard_links(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id with the same words), n_links (other documents at the threshold or above, copies included), component_id (smallest id reachable by links), kept (one row of its component, of the smallest id)."""
    rows = linked_rows(docs).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "class_id", "n_links", "component_id", (F.col("one") & (F.col("alone") | (F.col("_i") == 1))).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates (that of the smallest id), columns unchanged."""
    found = stored(linked_rows(docs).where("not alone and (not one or copies > 1)").select("u", "one"), "jaccard-gone")
    left = without(docs, own_key(), found.select("u"))
    rows = docs.select(own_key(), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    again = joined(rows, found.where("one").select("u"), "u").groupBy("u").agg(F.first("_row").alias("_row"))
    return left.unionByName(again.select("_row.*"))
