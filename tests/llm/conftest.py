"""Spark comes from the parent conftest; small frames are made here."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def frame(spark):
    """rows of (doc_id, text) or (doc_id, text, lang) -> a documents table."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] else 0) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """(doc_id, text) of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


#: Texts that every operator must take: null, empty, blank, one word, not ASCII, special strings, very long, repeated.
ODD = [None, "", " \n\t ", "one", "ÄÖ ñ 日本 \U0001d4b3", "<|endoftext|> </s>[INST] &lt; <b>", "a " * 30_000, "x" * 50_000, "same text here", "same text here"]
