"""The last earlier row of another table: values that are read now and then, carried on to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: int, strictly: bool = False) -> DataFrame:
    """``left`` with the columns of the row of ``right`` of the same keys that is the last one at or before (``strictly``: before) ``at``; nulls where there is none.

    Rows of both are sorted together and the last reading is carried on, so no range of rows is joined. Time is cut into
    stretches of ``width``: what the earlier stretches of a key leave behind is a row for each, and a stretch is the
    unit of work, so a key with most of the rows is spread. ``right`` has one row for each key and time (of several, any is taken) and no
    columns of ``left`` but these; null keys meet null keys, a null time meets nothing.
    """
    taken = [c for c in right.columns if c not in (*keys, at)]
    reading = F.struct(F.col(at).alias("_at"), *taken)
    part = F.floor(F.col(at) / width).alias("_part")
    r = right.where(F.col(at).isNotNull()).select(*keys, part, F.col(at), reading.alias("_reading"))
    ends = r.groupBy(*keys, "_part").agg(F.max_by("_reading", at).alias("_end"))
    mine = left.select(F.struct(*left.columns).alias("_row"), *keys, part, at)
    parts = ends.unionByName(mine.select(*keys, "_part").distinct(), allowMissingColumns=True).groupBy(*keys, "_part").agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_reading")).where("_reading is not null")
    # In a stretch: what is carried in comes first, then readings and rows in order; at the same time a reading counts unless it must be strictly earlier.
    none = F.lit(None)
    rows = mine.select(*keys, "_part", at, F.lit(1).alias("_kind"), "_row", none.cast(r.schema["_reading"].dataType).alias("_reading"))
    row = none.cast(mine.schema["_row"].dataType).alias("_row")
    reads = r.select(*keys, "_part", at, F.lit(2 if strictly else 0).alias("_kind"), row, "_reading")
    starts = carried.select(*keys, "_part", none.cast(left.schema[at].dataType).alias(at), F.lit(-1).alias("_kind"), row, "_reading")
    order = Window.partitionBy(*keys, "_part").orderBy(F.col(at).asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    every = rows.unionByName(reads).unionByName(starts).withColumn("_reading", F.last("_reading", ignorenulls=True).over(order))
    return every.where("_kind = 1").select("_row.*", *[F.when(F.col(f"_row.{at}").isNotNull(), F.col(f"_reading.{c}")).alias(c) for c in taken])
