"""Files of tracks, truths, clips, variants and results, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DETECTIONS = "clip string, frame long, tid long, x1 double, y1 double, x2 double, y2 double, conf double"
MANIFEST = "clips array<struct<name:string, video:string>>"
VARIANTS = "label_prefix string, clips array<string>, variants array<struct<id:string, name:string, notes:string, overrides:map<string,string>, env:map<string,string>>>"
RESULTS = "array<struct<variant:string, env:map<string,string>, mean_idf1:double, mean_mota:double, num_switches_total:double, num_misses_total:double, num_false_positives_total:double, per_clip:map<string,struct<idf1:double, mota:double, num_switches:double, num_misses:double, num_false_positives:double, pipeline_seconds:double>>>>"


def read_mot(spark: SparkSession, path: str, min_conf: float | None = None) -> DataFrame:
    """MOT text (frame and corner from 1; x, y, width, height) as boxes from 0; ``clip`` is the folder above the file.

    Lines with fewer than six fields or with fields that are no numbers are passed over.
    """
    parts = F.split("value", ",")
    t = spark.read.text(path, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/(?:gt/)?[^/]+$", 1).alias("clip"), parts.alias("p")).where(F.size("p") >= 6)
    v = lambda i, kind="double": F.expr(f"try_cast(trim(get(p, {i})) AS {kind})")
    t = t.select("clip", (v(0) - 1).cast("long").alias("frame"), v(1).cast("long").alias("tid"), (v(2) - 1).alias("x1"), (v(3) - 1).alias("y1"), v(4).alias("w"), v(5).alias("h"), F.coalesce(v(6), F.lit(1.0)).alias("conf"))
    t = t.where("frame is not null and tid is not null and x1 is not null and y1 is not null and w is not null and h is not null")
    out = t.select("clip", "frame", "tid", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), "conf")
    return out if min_conf is None else out.where(F.col("conf") >= min_conf)


def mot_lines(df: DataFrame) -> DataFrame:
    """(clip, frame, tid, line): rows as MOT text."""
    line = F.format_string("%d,%d,%.6f,%.6f,%.6f,%.6f,%.6f,1,-1", F.col("frame") + 1, F.col("tid"), F.col("x1") + 1, F.col("y1") + 1, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("conf"))
    return df.select("clip", "frame", "tid", line.alias("line"))


def write_mot(df: DataFrame, path: str) -> None:
    """One folder of text files for each clip, in order of frames inside each file."""
    mot_lines(df).repartition("clip").sortWithinPartitions("clip", "frame", "tid").select("clip", F.col("line").alias("value")).write.partitionBy("clip").text(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTIONS).parquet(path)


def write_detections(df: DataFrame, path: str) -> None:
    df.write.partitionBy("clip").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(place, clip, video) in the order of the file."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return m.select(F.posexplode("clips").alias("place", "c")).select("place", F.col("c.name").alias("clip"), F.col("c.video").alias("video"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(variant, key, value): overrides of each variant, a row without key for one that overrides nothing."""
    v = spark.read.schema(VARIANTS).json(path, multiLine=True).select(F.explode("variants").alias("v"))
    named = v.select(F.coalesce("v.id", "v.name").alias("variant"), F.coalesce("v.overrides", "v.env").alias("o"))
    return named.select(F.when(F.col("variant").isNull(), F.raise_error(F.lit("a variant needs a name"))).otherwise(F.col("variant")).alias("variant"), F.explode_outer("o").alias("key", "value"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(variant, clip, metric, value) of result files, which hold a list or {"variants": list}."""
    raw = spark.read.text(path, wholetext=True).select("value")
    rows = F.coalesce(F.from_json("value", f"struct<variants:{RESULTS}>")["variants"], F.from_json("value", RESULTS))
    c = raw.select(F.explode(rows).alias("r")).select("r.variant", F.explode("r.per_clip").alias("clip", "m"))
    names = ["idf1", "mota", "num_switches", "num_misses", "num_false_positives", "pipeline_seconds"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m.{n}").alias("value")) for n in names]))
    return c.select("variant", "clip", pairs.alias("x")).select("variant", "clip", "x.metric", "x.value").where("value is not null")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(clip, frame, path, content) of image folders: a clip is a folder, a frame the place of a file by name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,webp}").option("recursiveFileLookup", True).load(path)
    if not f.select("path").head(1):
        raise FileNotFoundError(f"no images in {path}")
    f = f.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("clip"), "path", "content")
    return f.withColumn("frame", F.row_number().over(Window.partitionBy("clip").orderBy("path")) - 1)


def with_images(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes with ``path`` and ``content`` of their frame (``read_frames``); null where there is no image. Only images of frames that are asked for travel."""
    asked = images.join(boxes.select("clip", "frame").distinct(), ["clip", "frame"], "left_semi")
    return boxes.join(asked.select("clip", "frame", "path", "content"), ["clip", "frame"], "left")


def clips_with_results(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(clip, path): folders below ``path`` that hold a result file, sorted; only names are read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    return f.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("clip"), "path").orderBy("clip", "path")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it lacks."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
