"""Operator 2: allow or block URLs by rules, and by logistic regression where no rule fits.

Features are character n-grams of host and path, hashed. The model is trained on a small labelled
URL table: by default the ``LABELLED`` URLs of the input with the least hashes for which a rule
gives the label. All steps are Spark's own (``pyspark.ml``), with coefficients of fixed size.

Defined cases: a null URL or one without ``://`` has an empty host and path; no labelled URL at all
allows what no rule decides; of rules of equal length the last in the order of their text counts; a probability
right at one half blocks; a URL of any length is read whole; repeated pages are judged alike; other columns
may have any names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); a rule fits its host and all subdomains.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Bound of the labelled table that the model is trained on.
LABELLED = 20_000
BUCKETS = 1 << 14


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0), F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def judged_by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngrams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of a marked text, all of it."""
    s = F.concat(F.lit(f"{mark}^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), s.substr(i, F.lit(n))))

    return F.concat(*map(of_size, sizes))


def featured(urls: DataFrame) -> DataFrame:
    grams = F.concat(ngrams(F.col("host"), "h", (3, 4)), ngrams(F.col("path"), "p", (3, 4)))
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features").transform(urls.withColumn("grams", grams)).drop("grams")


def train(labelled: DataFrame, bound: int = LABELLED):
    """A model from (host, path, label 1 for block); None without rows."""
    rows = labelled.select("host", "path", F.col("label").cast("double").alias("label")).distinct().orderBy(F.xxhash64("host", "path"), "label").limit(bound)
    rows = featured(rows).cache()
    try:
        if not rows.head(1):
            return None
        return LogisticRegression(maxIter=25, regParam=0.01).fit(rows)
    finally:
        rows.unpersist()


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (of the model; null without one)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("by_rule", judged_by_rules(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.where(F.col("by_rule").isNotNull()).select("host", "path", (F.col("by_rule.verdict") == "block").cast("int").alias("label"))
    model = train(labelled)
    if model is None:
        rows = rows.withColumn("p_block", F.lit(None).cast("double"))
    else:
        rows = model.transform(featured(rows)).withColumn("p_block", vector_to_array("probability")[1])
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", by_model).alias("verdict"), "p_block")
