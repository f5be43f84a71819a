"""A training-corpus pipeline of the operators in ``railyard.llm``.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir) and all but
the last return the columns of ``docs``. Between stages the rows are written as
Parquet to the shared folder of ``spark.checkpoint.dir`` and read back. Extra
columns pass through unchanged; an empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.llm import decontam, near_dedup, packing, quality_model, substring_dedup
from railyard.llm.common import materialise, reachable, table

#: Documents under this score are rejected.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), quality_model.remainder("doc_id", 5) != 0)
    name = "__score"
    return quality_model.score(docs, model, name=name).filter(F.col(name) >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates."""
    return near_dedup.dedupe(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat out of the texts; ``n_chars`` follows the text."""
    out = substring_dedup.dedupe(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item occurs."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return packing.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(f.__name__, reachable(f)) for f in (quality, near_duplicates, repeated_passages, benchmark_leaks, packed)]

#: The stages cannot be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
