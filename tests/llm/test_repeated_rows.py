"""Many rows of equal id and text."""

from __future__ import annotations

import hashlib
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from railyard.llm import chat_format, quality_model, substring_dedup


def test_substring_dedup_of_50_000_equal_rows(spark):
    words = " ".join(f"w{i * i % 977}" for i in range(120))
    equal = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit(words).alias("text"))
    other = spark.createDataFrame([(1, "own words here " + " ".join(words.split()[20:80]) + " and an end"), (2, " ".join(f"u{i}" for i in range(60))), (3, None)],
                                  "doc_id long, text string")
    start = time.time()
    got = substring_dedup.digest(equal.unionByName(other))
    counts = {(r.doc_id, r.n_words, r.n_removed): r.n for r in got.groupBy("doc_id", "n_words", "n_removed").agg(F.count("*").alias("n")).collect()}
    assert counts == {(7, 120, 120): 25_000, (None, 120, 120): 25_000, (1, 66, 60): 1, (2, 60, 0): 1, (3, 0, 0): 1}
    assert time.time() - start < 120


def test_indicators_of_many_short_rows_take_memory_by_their_text():
    texts = [f"row {i} has words {i % 7}, a few.".encode() for i in range(20_000)]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    tracemalloc.start()
    row, bucket = quality_model.indicators(raw, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and row[-1] == 19_999
    # one row alone, and a few rows in a table of flags, have the same indicators
    for i in (0, 5, 19_999):
        alone = quality_model.indicators(raw[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
        assert (alone[1] == bucket[row == i]).all()
    long = [(" ".join(texts[i].decode() for i in range(k, k + 400))).encode() for k in (0, 3000)]
    raw2, off2 = np.frombuffer(b"".join(long), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in long])))
    both, sparse = quality_model.indicators(raw2, off2), None
    before, quality_model.DENSE = quality_model.DENSE, 0
    try:
        sparse = quality_model.indicators(raw2, off2)
    finally:
        quality_model.DENSE = before
    assert all((a == b).all() for a, b in zip(both, sparse))


def test_a_conversation_of_200_000_turns_is_formatted_in_linear_time(spark):
    n = 200_000
    turns = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") < n // 2, F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")).otherwise("assistant").alias("role"),
                                  F.concat(F.lit("é<&[turn "), "id").alias("text"))
    start = time.time()
    got = {r.conv_id: r for r in chat_format.digest(turns).collect()}[5]
    learned = [f"é<&[turn {i}" for i in range(n) if i >= n // 2 or i % 2]
    assert (got.n_turns, got.loss_chars) == (n, sum(map(len, learned)))
    assert got.loss_sha256 == hashlib.sha256("".join(learned).encode()).hexdigest()
    role = lambda i: "assistant" if i >= n // 2 or i % 2 else "user"
    assert got.turns_sha256 == hashlib.sha256("".join(f"{role(i)}\né<&[turn {i}\n" for i in range(n)).encode()).hexdigest()
    assert time.time() - start < 90


def test_spans_across_pieces_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE", 3)
    text = "ab\U0001d4b3c\né\U0001f600\U0001f600xyz\r\nend\U0001d4b3"
    spans = [(i, k) for i in range(len(text) + 1) for k in (0, 1, 2, 3, 7) if i + k <= len(text)]
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,length:int>>")
    assert df.select(chat_format.spans_of(F.col("t"), F.col("s")).alias("x")).first().x == [text[i : i + k] for i, k in spans]
