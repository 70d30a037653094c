"""Training corpus from ``documents``: five stages, each of one numbered operator.

Defined cases, for all stages: no rows give no rows; further columns of ``docs`` may have any names and stay as they
are; texts of any length are handled whole. A null or empty text has no perplexity and goes in the first stage, and
null ids and sources are kept. Rows that repeat in all columns are judged alike; one of them stays in the second
stage, and the fourth takes what is left alike. Documents that share an id but not their text stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontaminate, jaccard, mixing, quality, tokens
from trackloom.llm.queries import tokenizer_path
from trackloom.llm.store import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the language model rejects go."""
    return quality.of_quality(docs, quality.trusted_ids(_side(spark, sf_dir, "labels")), tokenizer_path())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies stays."""
    return jaccard.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold benchmark passages go."""
    return decontaminate.decontaminated(docs, _side(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents as often as the mix takes them."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids in files, and what the files say of each document."""
    return tokens.token_ids(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: No SQL: language model, MinHash classes and tokenizer are beyond it; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _side(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
