"""Reports over metric tables (variant, clip, tracker, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import finite


def pivoted(metrics: DataFrame, columns: str, values: list[str], metric: str) -> DataFrame:
    """Clips by tracker (or variant), one metric; the columns are named up front, so no extra job finds them."""
    return metrics.where(F.col("metric") == metric).groupBy("clip").pivot(columns, values).agg(F.first("value"))


def against_baseline(summary: DataFrame, value: str, name: str = "variant", baseline: str = "baseline") -> DataFrame:
    """Adds the baseline's value, the difference, and that in percentage points as text. One baseline row is broadcast."""
    base = summary.where(F.col(name) == baseline).agg(F.max(value).alias("base"), F.count("*").alias("_n"))
    base = base.select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no row named {baseline}"))).otherwise(F.col("base")).alias("base"))
    out = summary.crossJoin(F.broadcast(base)).withColumn("delta", F.col(value) - F.col("base"))
    return out.withColumn("points", F.format_string("%+.4f", F.col("delta") * 100))


def worst(metrics: DataFrame, ours: str, metric: str = "idf1") -> DataFrame:
    """For each clip the weakest other tracker and how far ours is ahead."""
    m = metrics.where(F.col("metric") == metric)
    other = m.where(F.col("tracker") != ours)
    return m.groupBy("clip").agg(F.max(F.when(F.col("tracker") == ours, F.col("value"))).alias("ours")).join(
        other.groupBy("clip").agg(F.min_by("tracker", F.struct("value", "tracker")).alias("tracker"), F.min("value").alias("value")), "clip"
    ).withColumn("gap", F.col("ours") - F.col("value"))


def widest(gaps: DataFrame, n: int) -> DataFrame:
    return gaps.orderBy(F.col("gap").desc(), "clip").limit(n)


def interesting(metrics: DataFrame, ours: str, metric: str, least_points: float) -> DataFrame:
    """Clips where ours is ahead of the weakest by at least so many percentage points."""
    return worst(metrics, ours, metric).where(F.col("gap") * 100 >= least_points)


def safe_mean(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sum over finite values; without any the mean is NaN and the sum 0."""
    v = finite(F.col("value"))
    return metrics.groupBy(*by).agg(F.coalesce(F.avg(v), F.lit(float("nan"))).alias("mean"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("n"))


def ranked(means: DataFrame, value: str = "mean") -> DataFrame:
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.col(value).desc(), *[c for c in means.columns if c != value])))


def latency(times: DataFrame, by: list[str], ms: str = "ms") -> DataFrame:
    """Mean, median, 95th percentile and sum of times, and frames a second."""
    return times.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), F.percentile(ms, F.lit(0.5)).alias("median_ms"), F.percentile(ms, F.lit(0.95)).alias("p95_ms"), F.sum(ms).alias("total_ms"), (F.count("*") / (F.sum(ms) / 1000)).alias("fps"))


def speed_and_accuracy(metrics: DataFrame, times: DataFrame, metric: str = "idf1") -> DataFrame:
    """(tracker, accuracy, fps) of the trackers that have both."""
    a = metrics.where(F.col("metric") == metric).groupBy("tracker").agg(F.avg(finite(F.col("value"))).alias("accuracy"))
    return a.join(latency(times, ["tracker"]).select("tracker", "fps"), "tracker")


def head_to_head(metrics: DataFrame, metric: str = "idf1") -> DataFrame:
    """(a, b, clips, wins, mean_gap): for every two trackers the clips that both have, those where a is ahead, and by how much on average."""
    m = metrics.where(F.col("metric") == metric).groupBy("clip", "tracker").agg(F.avg("value").alias("value"))
    a, b = (m.select("clip", F.col("tracker").alias(k), F.col("value").alias(f"v_{k}")) for k in ("a", "b"))
    gap = F.col("v_a") - F.col("v_b")
    return a.join(b, "clip").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("clips"), F.count_if(gap > 0).alias("wins"), F.avg(gap).alias("mean_gap"))


def scoring_inputs(manifest: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """Every clip of the manifest (clip) with ``missing``: the sides, of results and truth (clip), that it lacks; null if it can be scored."""
    has = lambda df, name: df.select("clip").distinct().withColumn(name, F.lit(True))
    j = manifest.join(has(results, "_r"), "clip", "left").join(has(truth, "_t"), "clip", "left")
    missing = F.concat_ws(" ", F.when(F.col("_r").isNull(), "results"), F.when(F.col("_t").isNull(), "truth"))
    return j.withColumn("missing", F.when(missing != "", missing)).drop("_r", "_t")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more rows than ``most`` are an error, not cut off."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    rows = [df.columns, ["---"] * len(df.columns), *[[f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
