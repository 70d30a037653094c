"""All pairs inside groups, without making a row for a pair.

A group of at most ``rows`` members is one piece of work; a larger one is cut into blocks by a hash
and every pair of blocks is a piece, so that no task holds a whole large group. Small pieces share a
cell. What a piece returns is a row for each member at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.store import stored


def in_pieces(members: DataFrame, group: list[str], member: str, rows: int, weight: str | None = None, most: int | None = None, name: str = "sizes") -> DataFrame:
    """``members`` with ``i`` and ``j`` (the pair of blocks of its group), ``side`` (0 first block, 1 second, 2 the only one) and ``cell`` (a task's share).

    ``weight`` and ``most`` bound the sum of a block's weights besides its rows. Pieces of small groups are dealt into
    cells of about twice ``rows`` rows, those of large groups have a cell of their own.
    """
    sizes = members.groupBy(*group).agg(F.count("*").alias("_n"), F.sum(weight or F.lit(0)).alias("_w")).where("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / rows), F.ceil(F.col("_w") / (most or 1)) if weight else F.lit(1), F.lit(1)).cast("int")
    sizes = stored(sizes.select(*group, "_n", blocks.alias("_blocks")), name)
    small = sizes.where("_blocks = 1").agg(F.sum("_n")).head()[0] or 0
    m = members.join(sizes.drop("_n"), group)
    m = m.withColumn("_own", F.pmod(F.xxhash64(F.lit(11), member), "_blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks").cast("bigint") - 1), lambda o: F.struct(F.least("_own", o).alias("i"), F.greatest("_own", o).alias("j"), F.when(o == F.col("_own"), 2).when(F.col("_own") < o, 0).otherwise(1).alias("side")))
    piece = F.xxhash64(*group, "_p.i", "_p.j")
    cell = F.when(F.col("_blocks") == 1, F.pmod(piece, F.lit(max(1, -(-small // (2 * rows)))))).otherwise(piece)
    m = m.withColumn("_p", F.explode(pairs)).withColumns({"i": F.col("_p.i"), "j": F.col("_p.j"), "side": F.col("_p.side"), "cell": cell})
    return m.drop("_own", "_p", "_blocks")
