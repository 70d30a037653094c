"""Operator 10: quality by the perplexity of an n-gram model with modified Kneser-Ney smoothing.

The model is of pairs of token ids (``token_model``); its table grows with the trusted texts and stays in
a table. Trusted documents are dealt into two folds by a hash of their id, and every document is scored by
the model of the other fold: nothing is scored by counts it is part of. The threshold of a language
is a quantile of its trusted documents' perplexities.

Defined cases: a null or empty text, or one of blanks, has no perplexity and is rejected; a language without trusted
documents takes the threshold of all trusted ones; without any, all texts are kept; a text right at its
threshold is kept; repeated rows are scored alike; a text of any length is one text; other columns of
``docs`` may have any names and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import token_model
from trackloom.llm.filters import joined, without
from trackloom.llm.store import stored

QUANTILE = 0.998
BROADCAST_LANGUAGES = 10_000


def fold_of(column: str):
    return F.pmod(F.xxhash64(F.lit(3), F.col(column)), F.lit(2)).cast("int")


def thresholds(scores: DataFrame, trusted: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold) of each language, and one row with ``every`` set for all of them together."""
    t = scores.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").where("perplexity is not null")
    q = F.percentile_approx("perplexity", F.lit(quantile), F.lit(20_000)).alias("threshold")
    return t.groupBy("lang").agg(q).withColumn("every", F.lit(False)).unionByName(t.agg(q).select(F.lit(None).cast("string").alias("lang"), "threshold", F.lit(True).alias("every")))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (lang, perplexity) with threshold and kept."""
    limits = stored(limits, "quality-thresholds")
    every = limits.where("every").select(F.col("threshold").alias("_all"))
    own = limits.where("not every").select(F.col("lang").alias("_lang"), F.col("threshold").alias("_own"))
    own = F.broadcast(own) if own.count() <= BROADCAST_LANGUAGES else own
    out = rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").crossJoin(F.broadcast(every))
    limit = F.coalesce("_own", "_all", F.lit(float("inf")))
    return out.withColumn("threshold", limit).withColumn("kept", F.coalesce(F.col("perplexity") <= limit, F.lit(False))).drop("_lang", "_own", "_all")


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, fold, text, doc_id, lang): a text is scored by the model of the fold it is not in; k1 and k2 tell both apart."""
    fold, text = 1 - fold_of("doc_id"), F.col("text").cast("string")
    key = [F.xxhash64(F.lit(salt), fold, text).alias(f"k{salt}") for salt in (1, 2)]
    return docs.select(*key, fold.alias("fold"), text.alias("text"), "doc_id", "lang")


def limits_of(docs: DataFrame, trusted: DataFrame, tokenizer: str, quantile: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lang, k1, k2, perplexity) of every document, and the thresholds."""
    known = trusted.select("doc_id").where("doc_id is not null").distinct()
    own = joined(docs.select("doc_id", "text"), known, "doc_id", "left_semi").select(fold_of("doc_id").alias("fold"), F.col("text").cast("string").alias("text"))
    m = token_model.model(token_model.counted(own, tokenizer), tokenizer)
    rows = keyed(docs)
    sums = token_model.sums(rows, m, tokenizer).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    p = F.when(F.col("n") > 0, F.pow(F.lit(2.0), -F.col("s") / F.col("n")))
    met = rows.drop("text").join(sums.hint("merge"), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    scores = stored(met.select("doc_id", "lang", "k1", "k2", p.alias("perplexity")), "quality-scores")
    return scores, thresholds(scores, trusted, quantile)


def perplexities(docs: DataFrame, trusted: DataFrame, tokenizer: str, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept for every document."""
    scores, limits = limits_of(docs, trusted, tokenizer, quantile)
    return judged(scores, limits).select("doc_id", "lang", "perplexity", "threshold", "kept")


def of_quality(docs: DataFrame, trusted: DataFrame, tokenizer: str, quantile: float = QUANTILE) -> DataFrame:
    """The documents that are kept, columns unchanged. Only texts that may go are shuffled."""
    scores, limits = limits_of(docs, trusted, tokenizer, quantile)
    name = lambda k1, k2, lang: F.concat_ws(":", k1, k2, F.xxhash64(lang))
    gone = judged(scores, limits).where("not kept").select(name("k1", "k2", "lang").alias("gone")).distinct()
    fold, text = 1 - fold_of("doc_id"), F.col("text").cast("string")
    return without(docs, name(F.xxhash64(F.lit(1), fold, text), F.xxhash64(F.lit(2), fold, text), F.col("lang")), stored(gone, "quality-gone"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good and not toxic in all their rows."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
