"""Tables that are built once: kept by what they are made of, clip by clip, and found again.

A clip's key is a fingerprint of its rows and of the configuration. What a build makes goes to a folder of its own, and
a manifest names the folder for each clip only when all of it is written; so a build that fails leaves nothing that is ever
read, and two builds at once leave one clip twice, of which one is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.store import stored, writing

MANIFEST = "clip string, key string, batch string, built_rows long"


def fingerprints(df: DataFrame, config: str) -> DataFrame:
    """(clip, key): rows in any order, two sums of 64-bit hashes of them and their number, with ``config``. Adds up before the shuffle."""
    rows = F.struct(*sorted(df.columns))
    sums = [F.sum(F.xxhash64(F.lit(salt), rows).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
    of = df.groupBy("clip").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("_s"))
    return of.select("clip", F.sha2(F.concat_ws("|", F.lit(config), F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)), "_s"), 256).alias("key"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """What has been built: a row for each clip and key. None where nothing has."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def scan_or_build(df: DataFrame, build: Callable[[DataFrame], DataFrame], config: str, root: str) -> DataFrame:
    """``build(df)``, clip by clip: clips that ``root`` has for these rows and this ``config`` are read, only the others are built.

    ``build`` must treat clips apart and give rows with ``clip``. A clip of which it leaves nothing counts as built.
    """
    spark = df.sparkSession
    keys = fingerprints(df, config)
    asked = stored(keys.join(manifest(spark, root), ["clip", "key"], "left_anti"), "cache-asked")
    if not asked.isEmpty():
        batch = uuid.uuid4().hex
        made = build(df.join(asked.select("clip"), "clip", "left_semi"))
        with writing(spark):
            made.write.parquet(f"{root}/batch-{batch}")
        n = spark.read.schema(made.schema).parquet(f"{root}/batch-{batch}").groupBy("clip").agg(F.count("*").alias("n"))
        done = asked.join(n, "clip", "left").select("clip", "key", F.lit(batch).alias("batch"), F.coalesce("n", F.lit(0)).cast("long").alias("built_rows"))
        done.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    found = manifest(spark, root).join(keys, ["clip", "key"]).groupBy("clip").agg(F.min("batch").alias("batch"))
    batches = [r.batch for r in found.select("batch").distinct().collect()]  # a row for each build
    if not batches:
        return build(df.limit(0))
    data = spark.read.parquet(*[f"{root}/batch-{b}" for b in batches])
    of = F.regexp_extract(F.col("_metadata.file_path"), r"batch-([0-9a-f]+)/", 1)
    return data.withColumn("_batch", of).join(found.withColumnRenamed("batch", "_batch"), ["clip", "_batch"], "left_semi").drop("_batch")
