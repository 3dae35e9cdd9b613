"""One query for each corpus operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import common, decontaminate, ngram_join, quality_classifier, quality_rules, secrets, sentencepiece_viterbi, sharding, suffix_array, suffix_tree, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.suffix_array_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_viterbi.encode(docs)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages")).write.parquet(path)
    return warc.read_archives(spark.read.parquet(path)).drop("url", "archive")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_array, op2_substring_dedup, op3_sharding, op4_sentencepiece, op5_quality_rules, op6_decontaminate, op7_ngram_join, op8_warc, op9_quality_classifier, op10_secrets)}

SQL: dict[str, str] = {
    "op8_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM r
    """,
}
