"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from railyard.llm import (chat_format, decontam, html_extract, importance, language_id, line_dedup, near_dedup, packing, prefix_trie, quality_model, quality_rules,
                          substring_dedup, token_counts)
from railyard.llm.common import reachable, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(table(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = [op1_token_counts, op2_decontamination, op3_substring_dedup, op4_chat_format, op5_language_id, op6_quality_rules, op7_packing, op8_near_dedup,
           op9_html_extraction, op10_quality_classifier, op11_line_dedup, op12_prefix_trie, op13_importance_resampling]


def queries() -> dict[str, Query]:
    return {f.__name__: reachable(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat_format.DIGEST_SQL, "op11_line_dedup": line_dedup.DIGEST_SQL, "op12_prefix_trie": prefix_trie.DIGEST_SQL,
            "op13_importance_resampling": importance.DIGEST_SQL}
