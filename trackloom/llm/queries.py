"""Queries of the numbered operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import conversations, decontaminate, embeddings, html_text, jaccard, merkle, mixing, oracles, pii, quality, repeats, secrets, tokens, urls

#: Where the public tokenizer files are; a parameter, nothing is copied.
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents")).drop("found")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_ids(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("doc_id", tokens.least_null(F.col("doc_id")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("dk")


def passages_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches of operator 6: documents that hold the words of a benchmark window close together, in any order."""
    return decontaminate.proximity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents")).drop("found")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.perplexities(_table(spark, sf_dir, "documents"), quality.trusted_ids(_table(spark, sf_dir, "labels")), tokenizer_path())


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_pii": op3_pii,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_token_ids": op5_token_ids,
    "op6_decontamination": op6_decontamination,
    "passages_nearby": passages_nearby,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_html_text": op11_html_text,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_WORD_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORD_SQL} AS ws FROM documents),
b AS (SELECT item_id, {_WORD_SQL} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i + 1 : i + least(13, len(ws))], ' ') AS phrase
       FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS phrase
       FROM (SELECT rid, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hits AS (SELECT rid, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN ids USING (rid)""",
    "op12_conversation_repair": oracles.CONVERSATIONS,
    "op13_merkle_manifest": oracles.MERKLE,
}
