"""The queries over the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from koine.llm import bpe, conversations, exact_dedup, fingerprints, minhash, mixing, sharding, substring_dedup, token_counts, toxicity, url_filter, warc, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_documents, _labels, _pages = _table("documents"), _table("labels"), _table("pages")
_conversations, _embeddings = _table("conversations"), _table("embeddings")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_documents(spark, sf_dir))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(_pages(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), width=2)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir), RANKS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), RANKS)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(_documents(spark, sf_dir))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_report(_pages(spark, sf_dir))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(_conversations(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(_embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_suffix_array": op4_suffix_array,
    "op5_warc": op5_warc,
    "op6_minhash": op6_minhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_conversations": op12_conversations,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op5_warc": warc.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
