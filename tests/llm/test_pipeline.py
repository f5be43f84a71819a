"""Every stage of the pipeline against a brute-force version of its own input,
and the whole run against the stages."""

from __future__ import annotations

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from railyard.llm import quality_model
from railyard.llm.common import materialise
from tests.llm.conftest import DOCS
from tests.llm.test_operators import VOCABULARY, WORDS, brute_components, brute_leaks, brute_repeats, sha

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_and_run(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "packed"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns

    kept = materialise(stages["quality"](spark, docs, SF))
    predicted = {r.doc_id for r in quality_model.digest(docs, labels).filter("predicted = 1").collect()}
    assert kept.columns == columns and {i for i, _ in texts(kept)} == predicted and 100 < len(predicted) < 200

    one = materialise(stages["near_duplicates"](spark, kept, SF))
    before = texts(kept)
    assert one.columns == columns
    assert collections.Counter(texts(one)) == collections.Counter(x for x, c in zip(before, brute_components(before)) if c[3])

    cut = materialise(stages["repeated_passages"](spark, one, SF))
    before = texts(one)
    want = {i: (removed, digest) for i, _, removed, digest in brute_repeats(before, 35)}
    assert cut.columns == columns
    for r in cut.collect():
        assert sha(" ".join(WORDS.findall(r.text or ""))) == want[r.doc_id][1] and r.n_chars == len(r.text)
        assert want[r.doc_id][0] or r.text == dict(before)[r.doc_id]

    clean = materialise(stages["benchmark_leaks"](spark, cut, SF))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == columns
    assert {i for i, _ in texts(clean)} == {x[0] for x in brute_leaks(texts(cut), items) if not x[5]}

    packed = stages["packed"](spark, clean, SF).collect()
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts(clean)}
    covered = collections.Counter()
    for p in packed:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        covered[p.doc_id] += p.length
    assert covered == {i: len(x) for i, x in ids.items()}

    row = lambda p: (p.doc_id, p.doc_tokens)
    assert {row(p) for p in corpus_pipeline.run(spark, SF).collect()} == {row(p) for p in packed}
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_tables(spark):
    rows = [(1, None, None, None, None), (None, "text without id", "en", "s", None), (2, "", "en", None, 0), (3, "same words here", None, "s", 15), (3, "same words here", None, "s", 15)]
    odd = spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit("x")).withColumn("label", F.lit(1))
    for frame in (odd, odd.limit(0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, SF))
            assert docs.columns == odd.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
