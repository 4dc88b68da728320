"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, decontaminate, mixing, quality, repeats, secretscan, shards, simhash, urlrules, vectors


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.passes(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op2_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, _read(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.duplicated(_read(spark, sf_dir, "documents", "doc_id", "text"))


#: The rules of the contract, host, path and verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(_read(spark, sf_dir, "pages", "page_id", "url"), rules)


OP6_SQL = """
WITH u AS (
  SELECT page_id, row_number() OVER () AS n,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.n ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shard_slots": op2_shard_slots,
    "op3_simhash": op3_simhash,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_rules": op6_url_rules,
    "op7_remove_repeats": op7_remove_repeats,
    "op8_quality": op8_quality,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_vectors": op10_vectors,
}

SQL: dict[str, str] = {"op6_url_rules": OP6_SQL}
