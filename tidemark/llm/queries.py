"""One registered query per operator of this package, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard, pii, quality, repeats, secret_scan, topk, toxicity, wordpiece


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), wordpiece.pieces_of(public_tokenizers.path("word_bpe_49k.json")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.find_secrets(_table(spark, sf_dir, "documents")), secret_scan.BASE_KINDS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(pii.find_pii(_table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_token_counts, op4_jaccard_join, op5_secret_scan, op6_quality, op7_byte_bpe, op8_pii, op9_exact_topk, op10_repeats)
}

ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontaminate.ORACLE_SQL, "op4_jaccard_join": jaccard.ORACLE_SQL, "op9_exact_topk": topk.ORACLE_SQL, "op10_repeats": repeats.ORACLE_SQL}
