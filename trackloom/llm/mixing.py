"""Operator 9: mix sources to target weights by capped water-filling.

Sources share the words of all documents by weight. Sources whose share is above ``max_epochs`` times their own size are
clamped there and the excess is shared again among the others, until none is above: a sum over the table of sources a turn.

A source at ``e`` epochs takes every document ``floor(e)`` times, and once more those that come first in a seeded order,
up to its target. The order is a hash of id, source and text; rows that repeat follow one another in it, and any number
of them may be taken. The place where the source is cut is found from sums over 4,096 ranges of the hash, made before
the shuffle; only the range with the cut is looked at more closely, where rows that repeat are first counted by task. So
neither a source nor one document holding a third of all rows meets in one task.

At the cut some words are missing, fewer than the next document has. A few documents of each class of sizes, the nearest
ones before the cut and behind it, are then chosen anew: of all their subsets the one that brings the source nearest to
its target (sums of sizes as bits of a number, so all subsets are tried). A source of few documents is decided exactly.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows that repeat in id,
source and text are one document that is there several times, and which of them is taken doesn't matter; ties of
closeness go to the smaller sum; a text of any length is taken whole or not at all, so a source whose documents can't be
summed up nearer to its target ends beside it; no rows give no rows; other columns may have any names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.store import stored

WORD_RUN = r"[^\x20\x09-\x0D]+"
RANGE_BITS = 12
#: A plan of at most so many bytes is broadcast; a larger one is joined by a shuffle that splits skewed sources.
BROADCAST_BYTES = 32 << 20
#: Documents of a class of sizes (powers of two) on either side of the cut that are chosen anew.
NEAREST = 4
#: Sums of sizes are told apart up to so many; larger ones are measured in a unit of more than a word.
SUMS = 1 << 20
#: Bits of a row's number below the number of the task that wrote it.
TASK_BITS = 33


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def seeded_order(seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code-point order, null last. Sorted in ranges; the window sees a row for each task."""
    by_name = F.col("source").asc_nulls_last()
    s = sources.repartitionByRange(by_name).sortWithinPartitions(by_name).withColumn("_u", F.monotonically_increasing_id())
    s = stored(s, "mix-ranks")
    task = F.shiftright("_u", TASK_BITS)
    before = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    tasks = s.groupBy(task.alias("_t")).agg(F.count("*").alias("n")).select("_t", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.col("_u").bitwiseAND((1 << TASK_BITS) - 1)
    return s.join(tasks, task == F.col("_t")).withColumn("rank", rank).drop("_u", "_t", "_start")


def water_fill(sources: DataFrame, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` (source, source_size) with ``target``. Each turn clamps those above their cap; all sums are of whole numbers and so the same in any order."""
    at = (F.col("rank") % len(weights) + 1).cast("int")
    s = ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), at))
    s = stored(s.withColumn("cap", F.col("source_size") * float(max_epochs)).drop("rank"), "mix-caps")
    total, weight = (x or 0.0 for x in s.agg(F.sum("source_size"), F.sum("weight")).head())
    level, before = total / weight if weight else 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * level
        clamped, held, left = s.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).head()
        if clamped == before or not left:
            break
        before, level = clamped, (total - (held or 0.0)) / left
    return s.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def sized(docs: DataFrame, seed: int, *columns: Column) -> DataFrame:
    """``columns`` with source, size, place in the seeded order (``h``) and a number (``u``) that tells rows apart, kept as a table."""
    rows = docs.select(*columns, "source", word_count(F.col("text")).alias("size"), seeded_order(seed).alias("h"))
    return stored(rows.withColumn("u", F.monotonically_increasing_id()), "mix-sizes")


def nearest_sum(sizes: list[int], goal: int) -> list[bool]:
    """Which of ``sizes`` to add up to come nearest to ``goal``; of two sums as near the smaller."""
    unit = max(1, -(-(goal + max(sizes, default=0)) // SUMS))
    parts = [max(1, round(x / unit)) for x in sizes]
    want = round(goal / unit)
    mask = (1 << (2 * want + 2)) - 1  # a sum above is further off than nothing at all
    layers = [1]
    for p in parts:
        layers.append((layers[-1] | layers[-1] << p) & mask)
    low = (layers[-1] & ((1 << (want + 1)) - 1)).bit_length() - 1
    rest = layers[-1] >> (want + 1)
    high = want + 1 + (rest & -rest).bit_length() - 1 if rest else None
    at = high if high is not None and high - want < want - low else low
    chosen = [False] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        if not layers[i] >> at & 1:
            chosen[i] = True
            at -= parts[i]
    return chosen


def same_source(a: DataFrame, b: DataFrame, name: str) -> Column:
    return a["source"].eqNullSafe(b[name])


def cut_places(rows: DataFrame, ranges: DataFrame, s: DataFrame) -> DataFrame:
    """For every source that is cut: the last row taken once more (``cut_h``, ``cut_u``) and the words still missing (``gap``)."""
    bits = 64 - RANGE_BITS
    running = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    p = s.where("part > 0").select(F.col("source").alias("p_source"), "part")
    at = ranges.join(p, same_source(ranges, p, "p_source")).where((F.col("before") <= F.col("part")) & (F.col("before") + F.col("n") > F.col("part")))
    at = at.select("p_source", F.col("r").alias("p_r"), (F.col("part") - F.col("before")).alias("left"))
    near = rows.select("source", "size", "h", "u", F.shiftright("h", bits).alias("r"), F.shiftright("u", TASK_BITS).alias("task"))
    near = near.join(at, same_source(near, at, "p_source") & (F.col("r") == F.col("p_r")))
    # Rows that repeat count as one by task, so that a document of many rows is few here.
    piles = near.groupBy("source", "h", "task", "size").agg(F.count("*").alias("n"), F.min("u").alias("first"), F.first("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("h", "task", "size")
    piles = piles.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(upto)).withColumn("under", F.col("upto") - F.col("n") * F.col("size"))
    piles = piles.where((F.col("under") <= F.col("left")) & (F.col("upto") > F.col("left")))
    taken = F.floor((F.col("left") - F.col("under")) / F.col("size"))
    piles = piles.select(F.col("source").alias("c_source"), F.col("h").alias("cut_h"), "task", F.col("size").alias("c_size"), taken.alias("taken"), (F.col("left") - F.col("under") - taken * F.col("size")).alias("gap"))
    piles = stored(piles, "mix-piles")
    # The pile that is cut holds rows of one task of the writing; its rows are counted off.
    b = piles.select("c_source", "cut_h", F.col("task").alias("c_task"), "c_size", "taken").where("taken > 0")
    own = rows.select("source", "size", "h", "u").join(b, same_source(rows, b, "c_source") & (rows["h"] == b["cut_h"]) & (F.shiftright("u", TASK_BITS) == b["c_task"]) & (rows["size"] == b["c_size"]))
    own = own.withColumn("_i", F.row_number().over(Window.partitionBy("source", "h").orderBy("u"))).where("_i = taken").select(F.col("source").alias("o_source"), "u")
    none = F.shiftleft(F.col("task"), TASK_BITS) - 1  # the last number of the tasks before
    return piles.join(own, piles["c_source"].eqNullSafe(own["o_source"]), "left").select("c_source", "cut_h", F.coalesce("u", none).alias("cut_u"), "gap")


def upto_cut() -> Column:
    return F.coalesce((F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("u") <= F.col("cut_u"))), F.lit(False))


def flips(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(f_source, flips): numbers of rows that change sides, so that a source comes nearer to its target."""
    c = cuts.where("gap >= 0.5")
    near = rows.select("source", "size", "h", "u").where("size > 0")
    near = near.join(small(c), same_source(near, c, "c_source")).withColumn("in", upto_cut())
    klass = F.floor(F.log2(F.col("size")))
    from_cut = F.when(F.col("in"), -F.col("h") - 1).otherwise(F.col("h"))  # -h - 1 has no overflow and turns the order round
    w = Window.partitionBy("source", "in", klass).orderBy(from_cut, "u")
    near = near.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= NEAREST)  # pushed below the shuffle by Spark

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "u"])
        sizes, inside = [int(x) for x in pdf["size"]], list(pdf["in"])
        goal = math.floor(pdf["gap"].iloc[0] + 0.5) + sum(x for x, i in zip(sizes, inside, strict=True) if i)
        turned = [u for u, i, c in zip(pdf["u"], inside, nearest_sum(sizes, goal), strict=True) if i != c]
        return pd.DataFrame({"f_source": [pdf["source"].iloc[0]], "flips": [turned]})

    kind = rows.schema["source"].dataType.simpleString()
    return near.select("source", "size", "h", "u", "in", "gap").groupBy("source").applyInPandas(choose, f"f_source {kind}, flips array<long>")


def plan_mix(rows: DataFrame, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """A row for each source: p_source, source_size, target, whole (repetitions of all its documents), cut_h and cut_u (rows up to there are taken once more) and flips (rows that are not as their side says)."""
    ranges = stored(rows.groupBy("source", F.shiftright("h", 64 - RANGE_BITS).alias("r")).agg(F.sum("size").alias("n")), "mix-ranges")
    s = water_fill(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    s = stored(s, "mix-sources")
    cuts = stored(cut_places(rows, ranges, s), "mix-cuts")
    turned = flips(rows, cuts)
    out = s.join(cuts, same_source(s, cuts, "c_source"), "left").join(turned, s["source"].eqNullSafe(turned["f_source"]), "left")
    none = F.array().cast("array<long>")
    return stored(out.select(s["source"].alias("p_source"), "source_size", "target", "whole", "cut_h", "cut_u", F.coalesce("flips", none).alias("flips")), "mix-plan")


def small(plan: DataFrame) -> DataFrame:
    """``plan``, marked for broadcast where its size allows; else Spark joins it by a shuffle that splits skewed sources."""
    lists = [c for c in plan.columns if c == "flips"]
    size = plan.agg(F.count("*") * 100 + sum((8 * F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in lists), F.lit(0))).head()[0]
    return F.broadcast(plan) if size <= BROADCAST_BYTES else plan


def copies() -> Column:
    """How often a row is taken."""
    once_more = upto_cut() != F.array_contains("flips", F.col("u"))
    return (F.col("whole") + once_more.cast("long")).cast("long")


def mix_report(docs: DataFrame, max_epochs: float = 3.0, weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = sized(docs, seed, F.col("doc_id"))
    p = plan_mix(rows, max_epochs, weights)
    d = rows.join(small(p), same_source(rows, p, "p_source"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(docs: DataFrame, max_epochs: float = 3.0, weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, columns unchanged.

    The plan has a row for each source. Documents are written once with their sizes, so that a row keeps its number.
    """
    rows = sized(docs, seed, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    p = plan_mix(rows, max_epochs, weights)
    d = rows.join(small(p), same_source(rows, p, "p_source")).withColumn("_n", copies()).where("_n > 0")
    return d.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
