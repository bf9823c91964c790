"""The queries of the operators, with SQL where it can state their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.llm import (
    decontamination, embedding_whitening, line_dedup, merkle_manifest, mixing, ngram_join, oracles, quality_classifier, quality_rules, secret_scan, sharding, suffix_dedup, token_counts, token_files,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.concat(base, "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_digests(token_files.write(documents(spark, sf_dir), tokenizer="byte_bpe_50k.json", end=0))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_deleted", F.concat_ws(",", "deleted").alias("deleted"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), words=4, percent=85)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.interleave(documents(spark, sf_dir), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "place")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allotment(documents(spark, sf_dir), share=1.5, cap=2.0, weights=(5, 2, 1))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified(documents(spark, sf_dir), fanout=2, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir), tokenizer="word_bpe_49k.json", limit=2048)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


QUERIES = (
    op1_secret_scan, op2_token_files, op3_line_dedup, op4_ngram_join, op5_sharding, op6_suffix_dedup, op7_decontamination, op8_quality_classifier, op9_quality_rules, op10_mixing,
    op11_merkle_manifest, op12_token_counts, op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
