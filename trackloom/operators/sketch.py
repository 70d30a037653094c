"""Sketches of clips that can be kept, merged and rolled up: how many ids, and quantiles of the confidence, without the boxes.

A row holds a distinct sketch and a quantile sketch of its share of the boxes, each of bounded size. Sketches of parts merge to that of the whole,
so new boxes are added to a kept table by its keys alone, and any grouping of the keys is a merge of rows, never a pass over boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct sketch, as a power of two (about 1.6 % standard error), and the size of a quantile sketch (about 1.3 % of ranks).
REGISTERS, QUANTILES = 12, 200


def sketches(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each group: boxes (a count), ids and confs (sketches of ``tid`` and ``conf``; null where all values are). Adds up before the shuffle."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("boxes"), F.hll_sketch_agg(F.col("tid"), F.lit(REGISTERS)).alias("ids"), F.kll_sketch_agg_double(F.col("conf"), F.lit(QUANTILES)).alias("confs")
    )


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the same keys made one."""
    return rows.groupBy(*keys).agg(F.sum("boxes").alias("boxes"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("confs").alias("confs"))


def added(kept: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The kept table with the sketches of new boxes in it; a key that only one has stays as it is."""
    return merged(kept.unionByName(new), keys)


def rolled_up(rows: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Every grouping of the keys (null: all of it; ``level`` tells groupings from null keys): boxes, distinct ids and quantiles of confidence, as estimated."""
    cube = rows.cube(*keys).agg(F.grouping_id().alias("level"), F.sum("boxes").alias("boxes"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("confs").alias("confs"))
    at = [F.kll_sketch_get_quantile_double("confs", F.lit(s)).alias(f"conf_p{round(100 * s)}") for s in shares]
    return cube.select(*keys, "level", "boxes", F.hll_sketch_estimate("ids").alias("ids"), *at)
