"""Benchmark decontamination (operator 2).

One Aho-Corasick automaton holds every window of the normalised benchmark
items; each text is normalised and scanned once, and hits are mapped back to
byte offsets of the original text.

Defined results: a null, empty or word-less text has no words, no hits and is
clean; a null or word-less item has no window; a null ``item_id`` still hits
but is not listed; repeated items are listed once; repeated document rows each
get their own row; an empty table gives no hits (or no rows). Extra columns are
passed through by :func:`annotate` under their own names, all of them by
:func:`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from railyard.llm.common import byte_table, materialise, slices, text_bytes, word_spans

#: Fixed: separator bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
SEPARATORS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WINDOW = 10
#: Most benchmark bytes in one automaton; a larger benchmark is cut into shards, scanned in turn.
SHARD_BYTES = 8 << 20

LEAK = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
                     T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

_NORMAL = bytes(0x20 if SEPARATORS[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def normal_words(text: str) -> list[str]:
    """Normalised words, one character per byte (latin-1 view of the UTF-8 bytes)."""
    return [w.decode("latin-1") for w in text.encode("utf-8").translate(_NORMAL).split()]


def build_automaton(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    """Automaton over `` w1 w2 .. wk `` patterns with (k, item ids) as values; None without any window."""
    patterns: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = normal_words(text or "")
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            patterns.setdefault(f" {' '.join(words[i : i + k])} ", (k, set()))[1].add(item)
    if not patterns:
        return None
    automaton = ahocorasick.Automaton()
    for p, v in patterns.items():
        automaton.add_word(p, v)
    automaton.make_automaton()
    return automaton


def scan(raw: np.ndarray, automaton) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, hit word ranges, item ids) of one text."""
    words = raw.tobytes().translate(_NORMAL).split()
    if not words or automaton is None:
        return len(words), [], set()
    ranges, items, places = [], set(), None
    for at, (k, ids) in automaton.iter(" " + b" ".join(words).decode("latin-1") + " "):
        if places is None:  # position of the space after each word
            places = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = int(np.searchsorted(places, at))
        ranges.append((last - k + 1, last + 1))
        items |= ids
    return len(words), ranges, items


def _entry(raw: np.ndarray, automaton, before: dict | None) -> dict:
    """The ``leak`` value of one text, added to what earlier shards found."""
    n, found, ids = scan(raw, automaton)
    out = before or {"n_words": n, "n_hit": 0, "items": [], "spans": []}
    if not found:
        return out
    start, end, _ = word_spans(raw, np.array([0, len(raw)]), SEPARATORS)
    hit = np.zeros(n, bool)
    for s in out["spans"]:
        hit[np.searchsorted(start, s["start"]) : np.searchsorted(start, s["end"])] = True
    for a, b in found:
        hit[a:b] = True
    step = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return {"n_words": n, "n_hit": int(hit.sum()), "items": sorted({*out["items"], *(str(x) for x in ids if x is not None)}),
            "spans": [{"start": int(start[a]), "end": int(end[b - 1])} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]}


def annotate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
             item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, keep: list[str] | None = None, name: str = "leak") -> DataFrame:
    """``docs`` (the columns in ``keep``, or all) plus a struct column ``name``:
    n_words, n_hit, items (item ids, sorted as strings), spans (byte ranges of
    the original text for each maximal run of hit words).

    The benchmark is cut into shards of about ``shard_bytes`` by a hash of its
    text. Each shard's automaton is one bounded broadcast; with more than one,
    the shards scan the texts in turn, each result written to shared storage.
    Documents are never shuffled. An input column of that name is replaced.
    """
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    columns = [c for c in dict.fromkeys([*(docs.columns if keep is None else keep), text_column]) if c != name]
    out = docs.select(*[F.col(f"`{c}`") for c in columns])
    items = benchmark.select(F.col(item_column).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    for k in range(n):
        out = _scan_shard(out, items.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k), text_column, window, name)
        if k < n - 1:
            out = materialise(out)
    return out


def _scan_shard(docs: DataFrame, items: DataFrame, text_column: str, window: int, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in items.collect()])
    names = [c for c in docs.columns if c != name]
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in names]).schema.fields, T.StructField(name, LEAK)])
    kind = to_arrow_type(LEAK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(sent.value, window)
        for whole in batches:
            for part in slices(whole, text_column):
                raw, off, _ = text_bytes(part.column(text_column))
                before = part.column(name).to_pylist() if name in part.schema.names else [None] * part.num_rows
                rows = [_entry(raw[off[i] : off[i + 1]], automaton, before[i]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rows, kind)], names=[*names, name])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which any benchmark window occurs."""
    name = "__leak"
    return annotate(docs, benchmark, name=name, **options).filter(F.col(name)["n_hit"] == 0).drop(name)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return annotate(docs, benchmark, keep=["doc_id"]).select(
        "doc_id", F.col("leak.n_words").alias("n_words"), F.col("leak.n_hit").alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "leak.items"), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"))
