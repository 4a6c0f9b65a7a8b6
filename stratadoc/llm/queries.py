"""Registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratadoc.llm import (
    decontamination,
    disclosure,
    embedding_dups,
    language,
    merkle,
    minmax_dups,
    packing,
    quality_rules,
    suffix_dedup,
    token_files,
    toxicity,
    url_rules,
    whitening,
)
from stratadoc.llm.common import ready
from stratadoc.llm.oracle import ORACLE as ORACLE


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(_table(spark, folder, "pages"))


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(_table(spark, folder, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_embedding_dups(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dups.near_vectors(_table(spark, folder, "embeddings"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.judged(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.judged(_table(spark, folder, "documents"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_minmax_dups(spark: SparkSession, folder: str) -> DataFrame:
    return minmax_dups.near_duplicates(_table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(_table(spark, folder, "documents"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_rules, op2_token_files, op3_packing, op4_embedding_dups, op5_decontamination,
        op6_disclosure, op7_language, op8_suffix_dedup, op9_toxicity, op10_minmax_dups,
        op11_whitening, op12_merkle, op13_quality_rules,
    )
}
