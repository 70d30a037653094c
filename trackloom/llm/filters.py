"""Joins of large texts with sets of ids, without shuffling the texts that the set can't hold.

A Bloom filter of fixed size (at most 2**17 words of 64 bits, 2 MB) is made from the ids by a grouped
OR and broadcast. It never misses an id; the few texts that pass it wrongly are settled by the join
that follows. That join is always a merge join, so that the plan is alike at every size. With far more
ids than bits the filter passes everything, which costs a shuffle but no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def _bit(key: str):
    return F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(BITS))


def flagged(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: false only where ``key`` is not among the ids (the one column of ``ids``)."""
    b = ids.select(_bit(ids.columns[0]).alias("b"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))
    words = b.groupBy(F.floor(F.col("b") / 64).alias("_w")).agg(F.bit_or(one).alias("_m"))
    out = df.withColumn("_b", _bit(key)).withColumn("_w", F.floor(F.col("_b") / 64)).join(F.broadcast(words), "_w", "left")
    hit = F.coalesce(F.getbit("_m", (F.col("_b") % 64).cast("int")), F.lit(0).cast("tinyint")) == 1
    return out.withColumn("_maybe", hit).drop("_b", "_w", "_m")


def joined(df: DataFrame, lists: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Inner or left semi join on a key of the same name."""
    near = flagged(df, key, lists.select(key)).where("_maybe").drop("_maybe")
    return near.join(lists.hint("merge"), key, how)


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows whose key is not in ``gone`` (one column, distinct or not); only those that might be are shuffled.

    Rows travel as one struct, so their columns may have any names.
    """
    rows = df.select(key.alias("_key"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"))
    ids = gone.select(F.col(gone.columns[0]).alias("_key"))
    f = flagged(rows, "_key", ids)
    sure = f.where("not _maybe").select("_row")
    left = f.where("_maybe").join(ids.hint("merge"), "_key", "left_anti").select("_row")
    return sure.unionByName(left).select("_row.*")
