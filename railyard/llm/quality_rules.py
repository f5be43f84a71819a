"""Quality rules as a bitmask ledger (operator 6).

Every rule is evaluated once per text; the ledger keeps the measurements and
one integer of failure bits. Versioned policies are sets of bits applied to the
stored integer, and ablations (how many more documents a policy would keep
without one rule) are bitwise aggregations over the ledger, without touching
the texts again.

Defined results: a null, empty or word-less text has zero measurements and
fails the word-count rule; repeated rows each get a row; an empty table gives
an empty ledger and ablation counts of zero rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from railyard.llm.common import SPACE, batch_of, byte_table, mix, prefix, range_hash, slices, text_bytes, word_hashes, word_spans

#: Fixed: symbol characters ``[#*$%&|<>]``.
SYMBOLS = byte_table(b"#*$%&|<>")
WINDOW = 3

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Rules in bit order: name -> failing condition over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "short_words": "n_words > 0 and word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "many_symbols", "repeated_lines"],
    "v2": list(RULES),
}


def mask(rules: list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _distinct_counts(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each entry, how many entries share its (group, key)."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    run = np.cumsum(new) - 1
    out = np.empty(len(g), np.int64)
    out[order] = np.bincount(run)[run] if len(run) else 0
    return out


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of every row of a slice."""
    rows = len(off) - 1
    start, end, bound = word_spans(raw, off, SPACE)
    n_words = np.diff(bound)
    row = np.repeat(np.arange(rows), n_words)
    code_points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[raw])))
    chars = np.concatenate(([0], np.cumsum(code_points[end] - code_points[start])))
    out = {"n_words": n_words, "word_chars": chars[bound[1:]] - chars[bound[:-1]], "n_symbols": symbols[off[1:]] - symbols[off[:-1]]}

    # lines: cut at \n, blank ones (no word) left out, the rest compared whole
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    newline = np.flatnonzero(raw == 0x0A)
    begin = np.union1d(np.flatnonzero(cut), newline + 1)
    begin = begin[begin < len(raw)] if len(raw) else begin[:0]
    stop = np.concatenate((begin[1:], [len(raw)])) if len(begin) else begin
    stop = np.where((stop > begin) & (raw[np.maximum(stop, 1) - 1] == 0x0A), stop - 1, stop) if len(begin) else stop
    has_word = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[has_word], stop[has_word]
    line_row = np.searchsorted(off, begin, "right") - 1
    hashes = word_hashes(raw, begin, stop)
    order = np.lexsort((np.arange(len(begin)), hashes, line_row))
    same = np.zeros(len(begin), bool)
    if len(begin):
        a, b = order[:-1], order[1:]
        same[b] = (line_row[a] == line_row[b]) & (hashes[a] == hashes[b])
    out["n_dup_lines"] = np.bincount(line_row, same, rows).astype(np.int64) if len(begin) else np.zeros(rows, np.int64)
    out["n_lines"] = np.bincount(line_row, minlength=rows) if len(begin) else np.zeros(rows, np.int64)

    # words inside any 3-word window found twice or more in the same text
    hit = np.zeros(len(start) + 1, np.int64)
    at = np.arange(max(0, len(start) - WINDOW + 1))
    at = at[row[at] == row[at + WINDOW - 1]] if len(at) else at
    if len(at):
        sums = prefix(mix(word_hashes(raw, start, end)))
        repeated = at[_distinct_counts(row[at], range_hash(sums, at, at + WINDOW)) > 1]
        np.add.at(hit, repeated, 1)
        np.add.at(hit, repeated + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
    out["n_repeat_words"] = covered[bound[1:]] - covered[bound[:-1]]
    return out


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, the measurements, and ``failed``, the bits of the failed rules."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType([source.schema.fields[0], *[T.StructField(m, T.LongType()) for m in MEASURES]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                raw, off, _ = text_bytes(part.column("text"))
                m = measure(raw, off)
                yield batch_of(arrow, part.column("id"), *[m[k] for k in MEASURES])

    bits = sum((F.when(F.expr(f), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(RULES.values())), F.lit(0)).cast("long")
    return source.mapInArrow(run, schema).withColumn("failed", bits).withColumnRenamed("id", id_column)


def passes(policy: str) -> Column:
    """Does the ledger row pass the named policy?"""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only
    this rule rejects (what the policy without it would keep)."""
    whole = mask(POLICIES[policy])
    hits = [F.struct(F.lit(r).alias("rule"), F.lit(1 << i).alias("bit")) for i, r in enumerate(RULES) if r in POLICIES[policy]]
    grouped = book.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("f")).agg(F.count("*").alias("n"))
    return (grouped.select("f", "n", F.explode(F.array(*hits)).alias("h"))
            .groupBy(F.col("h.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("f").bitwiseAND(F.col("h.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("f") == F.col("h.bit"), F.col("n")).otherwise(0)).alias("n_only")))


def digest(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The digest columns of the registered query."""
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failed",
                               (~passes("base")).alias("base_failed"), passes(policy).alias("kept"))
