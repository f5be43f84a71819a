"""Substring dedup by recompression (operator 3).

Every text is parsed by rounds of recompression: maximal runs of equal symbols
are named (symbol, length), then neighbouring symbols of a left and a right
class (by a hash of the symbol and the round) are named as pairs. Names are
64-bit functions of what they stand for, alike in every task, so equal
substrings get the same symbols everywhere except near their ends; for every
symbol the parse keeps the words it depends on. A window of ``WINDOW`` words is
represented by one interior symbol that the window alone determines (the
highest level that has one; of several the one of least hash), so equal windows
have equal symbols at equal places, and neighbouring windows share theirs.

Spark then works on symbols, not on windows:

1. count every representative symbol over all texts; windows whose symbol
   occurs once are unique;
2. a stretch (the windows of one symbol occurrence) whose whole content occurs
   twice is repeated as a whole; hot passages and copies end here, and what
   repeats within one text (runs, periods) is settled inside its task;
3. only stretches whose symbol is shared but whose content is not are compared
   window by window, one per distinct content;
4. the words of repeated windows are removed.

Rows are joined by a hash of id and text, counts are pre-aggregated before every
shuffle, and joins against hot symbols are plain equi-joins that adaptive
execution splits.

Defined results: null, empty and blank texts have no words; texts shorter than
the window lose nothing; repeated rows are repeats of each other, so all of them
lose their windows; overlapping occurrences in one text count as each other's;
an empty table gives no rows; rows with a null id are treated like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from railyard.llm.common import SPACE, U64, batch_of, materialise, mix, prefix, range_hash, ranges, release, signed, slices, text_bytes, word_hashes, word_spans

WINDOW = 35
#: Rounds of recompression. A symbol of the third round depends on about a dozen words.
ROUNDS = 3


class Level:
    """The symbols of one round: name, first word, and the words [low, high) that determine it."""

    def __init__(self, name, first, low, high, row):
        self.name, self.first, self.low, self.high, self.row = name, first, low, high, row

    def __len__(self):
        return len(self.name)


def _round(level: Level, k: int, begin: np.ndarray, end: np.ndarray) -> Level:
    """One round: name runs, then pairs. ``begin`` and ``end`` are the word bounds of the rows."""
    n = len(level)
    if n == 0:
        return level
    name, row = level.name, level.row
    joined = np.zeros(n, bool)
    joined[1:] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
    at = np.flatnonzero(~joined)
    last = np.append(at[1:], n) - 1
    count = last - at + 1
    name = np.where(count > 1, mix(name[at] + mix(count.astype(U64) + U64(k << 40))), name[at])
    row = row[at]
    # that a run ends where it does depends on the symbols beside it, or on the ends of the row
    inner_left = np.zeros(len(at), bool)
    inner_left[1:] = row[1:] == row[:-1]
    inner_right = np.zeros(len(at), bool)
    inner_right[:-1] = row[1:] == row[:-1]
    low = np.where(inner_left, level.low[np.maximum(at - 1, 0)], begin[row] - 1)
    high = np.where(inner_right, level.high[np.minimum(last + 1, n - 1)], end[row] + 1)
    first = level.first[at]

    left = (mix(name ^ U64(0xA24BAED4963EE407 + k)) & U64(1)).astype(bool)
    opens = np.zeros(len(at), bool)
    opens[:-1] = left[:-1] & ~left[1:] & inner_right[:-1]
    second = np.zeros(len(at), bool)
    second[1:] = opens[:-1]
    keep = np.flatnonzero(~second)
    after, before = np.minimum(keep + 1, len(at) - 1), np.maximum(keep - 1, 0)
    paired = opens[keep]
    named = np.where(paired, mix(mix(name[keep] + U64(0x632BE59BD9B4E019 + k)) ^ name[after]), name[keep])
    new_low = np.where(paired | left[keep], low[keep], np.where(inner_left[keep], low[before], begin[row[keep]] - 1))
    new_high = np.where(paired, high[after], np.where(~left[keep], high[keep], np.where(inner_right[keep], high[after], end[row[keep]] + 1)))
    return Level(named, first[keep], new_low, new_high, row[keep])


def parse(words: np.ndarray, bound: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """Levels 0 (the words) to ``rounds`` of word hashes cut into rows at ``bound``."""
    at = np.arange(len(words))
    row = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    levels = [Level(words, at, at, at + 1, row)]
    for k in range(rounds):
        levels.append(_round(levels[-1], k, bound[:-1], bound[1:]))
    return levels


def _least(level: Level, start: np.ndarray, window: int) -> np.ndarray:
    """For each window start, the symbol of least hash among those the window determines (-1: none)."""
    a = np.searchsorted(level.low, start, "left")
    b = np.searchsorted(level.high, start + window, "right")
    out = np.full(len(start), -1, np.int64)
    has = np.flatnonzero(b > a)
    if not len(has):
        return out
    a, b = a[has], b[has]
    # order of the symbols: 40 bits of hash, then the leftmost
    order = mix(level.name + U64(0x2545F4914F6CDD1D)) >> U64(24)
    if len(order) < 1 << 24:
        table = order << U64(24) | np.arange(len(order), dtype=U64)
        place = None
    else:
        place = np.argsort(order, kind="stable")
        table = np.empty(len(place), U64)
        table[place] = np.arange(len(place), dtype=U64)
    power = np.log2(b - a + 0.5).astype(np.int64)
    best = np.empty(len(a), U64)
    for p in range(int(power.max()) + 1):
        on = power == p
        best[on] = np.minimum(table[a[on]], table[b[on] - (1 << p)])
        table = np.minimum(table[: -(1 << p)], table[1 << p :]) if len(table) > 1 << p else table
    out[has] = (best & U64(0xFFFFFF)).astype(np.int64) if place is None else place[best.astype(np.int64)]
    return out


def stretches(words: np.ndarray, bound: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(symbol, content, first window, windows) of every maximal stretch of
    windows of one representative symbol occurrence, in order."""
    counts = np.maximum(np.diff(bound) - window + 1, 0)
    start = ranges(bound[:-1], counts)
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, U64), start, start
    sums = prefix(mix(words ^ U64(0xD6E8FEB86659FD93)))
    level_of, symbol = np.full(len(start), -1), np.full(len(start), -1, np.int64)
    todo = np.arange(len(start))
    levels = parse(words, bound)
    for k in range(ROUNDS, -1, -1):
        got = _least(levels[k], start[todo], window)
        found = got >= 0
        level_of[todo[found]], symbol[todo[found]] = k, got[found]
        todo = todo[~found]
        if not len(todo):
            break
    new = np.ones(len(start), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (level_of[1:] != level_of[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    first, n = start[at], np.diff(np.append(at, len(start)))
    name, place = np.empty(len(at), U64), np.empty(len(at), np.int64)
    for k in range(ROUNDS + 1):
        on = np.flatnonzero(level_of[at] == k)
        if len(on):
            s, lv = symbol[at[on]], levels[k]
            name[on] = mix(lv.name[s] + U64(k)) ^ range_hash(sums, lv.low[s], lv.high[s])
            place[on] = lv.first[s] - first[on]
    content = range_hash(sums, first, first + n + window - 1) ^ mix((place.astype(U64) << U64(32)) + n.astype(U64))
    return name, content, first, n


def _text_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, off, _ = text_bytes(part.column("text"))
    start, end, bound = word_spans(raw, off, SPACE)
    return raw, off, word_hashes(raw, start, end), bound


def _lists(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _distinct(row: np.ndarray, symbol: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the stretches of each row: (index of the first of every distinct content,
    how often it occurs, and by stretch whether its content occurs twice in its row)."""
    order = np.lexsort((content, symbol, row))
    new = np.ones(len(order), bool)
    for x in (row, symbol, content):
        new[1:] &= x[order][1:] == x[order][:-1]
    new[1:] = ~new[1:]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    again = np.zeros(len(order), bool)
    again[order] = np.repeat(times > 1, times)
    first = order[at]  # lexsort is stable
    back = np.argsort(first, kind="stable")
    return first[back], times[back], again


def _parsed(docs: DataFrame, window: int) -> DataFrame:
    """Per row: id, key (a hash of id and text), n_words, digest of all words, its
    distinct stretches as arrays with how often each occurs, and ``own``: the
    window ranges that repeat within the text itself."""
    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([docs.schema["id"], T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("whole_sha256", T.StringType()),
                           *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("symbol", "content")],
                           *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("first", "n", "times")], T.StructField("own", spans)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                raw, off, words, bound = _text_words(part)
                symbol, content, first, n = stretches(words, bound, window)
                row = np.searchsorted(bound, first, "right") - 1
                some, times, again = _distinct(row, symbol, content)
                # ranges of windows whose stretches repeat in the same text, neighbours joined
                mine = np.flatnonzero(again)
                begin, end = first[mine], first[mine] + n[mine]
                opens = np.ones(len(mine), bool)
                opens[1:] = (begin[1:] != end[:-1]) | (row[mine][1:] != row[mine][:-1])
                closes = np.append(opens[1:], True)[: len(mine)]
                begin, end, owner = begin[opens], end[closes], row[mine][opens]
                own = pa.StructArray.from_arrays([pa.array((begin - bound[owner]).astype(np.int32)), pa.array((end - begin).astype(np.int32))], names=["first", "n"])
                rows = np.arange(part.num_rows + 1)
                cuts = np.searchsorted(row[some], rows)
                shas = [hashlib.sha256(b" ".join(raw[a:b].tobytes().split())).hexdigest() for a, b in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), pa.array(np.diff(bound)), pa.array(shas), _lists(signed(symbol[some]), cuts), _lists(signed(content[some]), cuts),
                     _lists(pa.array((first - bound[row])[some].astype(np.int32)), cuts), _lists(pa.array(n[some].astype(np.int32)), cuts),
                     _lists(pa.array(times.astype(np.int32)), cuts), _lists(own, np.searchsorted(owner, rows))], names=arrow.names).cast(arrow)

    return docs.mapInArrow(run, schema)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(symbol, hash, key, first, once) of every window of the listed stretches of each text."""
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("symbol", "hash", "key")], T.StructField("first", T.IntegerType()), T.StructField("once", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                _, _, words, bound = _text_words(part)
                sums = prefix(mix(words ^ U64(0xD6E8FEB86659FD93)))
                lists = part.column("compare")
                owner = np.repeat(np.arange(part.num_rows), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
                flat = lists.flatten()
                first, n = (flat.field(c).to_numpy() for c in ("first", "n"))
                row = np.repeat(np.arange(len(n)), n)
                at = ranges(first + bound[owner], n)
                key = part.column("key").to_numpy()[owner]
                yield batch_of(arrow, flat.field("symbol").to_numpy()[row], signed(range_hash(sums, at, at + window)), key[row],
                               (at - bound[owner][row]).astype(np.int32), flat.field("once").to_numpy(zero_copy_only=False)[row])

    return texts.mapInArrow(run, schema)


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """Per key: n_removed, kept_text and its digest, from the repeated stretches ``spans`` of each text."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                raw, off, _ = text_bytes(part.column("text"))
                removed, kept = [], []
                for i, spans in enumerate(part.column("spans")):
                    words = raw[off[i] : off[i + 1]].tobytes().split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    first, n = (spans.values.field(c).to_numpy() for c in ("first", "n"))
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n + window - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    removed.append(len(words) - int(stays.sum()))
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(stays)]))
                yield batch_of(arrow, part.column("key"), removed, [k.decode() for k in kept], [hashlib.sha256(k).hexdigest() for k in kept])

    return texts.mapInArrow(run, schema)


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts). rows: id, key, n_words, whole_sha256 of every input row.
    cuts: key, n_removed, kept_text, kept_sha256 of the texts that lose words."""
    source = keyed(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "id", "text")
    parsed = materialise(_parsed(source, window))
    texts, spans = _repeated(source, parsed, window)
    rows = materialise(parsed.select("id", "key", "n_words", "whole_sha256"))
    release(parsed)
    cuts = materialise(_cut(texts.select("key", "text").join(spans, "key"), window))
    release(texts, spans)
    return rows, cuts


def _repeated(source: DataFrame, parsed: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(key, text, ..) and (key, spans) of the texts with repeated windows; spans are ranges of windows."""
    each = parsed.select("key", F.explode(F.arrays_zip("symbol", "content", "first", "n", "times")).alias("s")).select("key", "s.*")
    # 1. symbols that occur more than once; do their contents differ? (written, so that
    # the join below stands by itself and a hot symbol's side can be split)
    shared = materialise(each.groupBy("symbol").agg(F.sum("times").alias("c"), F.min("content").alias("a"), F.max("content").alias("b"))
                         .filter("c > 1").select("symbol", (F.col("a") != F.col("b")).alias("mixed")))
    found = materialise(each.join(shared, "symbol"))
    release(shared)
    # 2. contents that occur more than once
    contents = (found.filter("mixed").groupBy("symbol", "content")
                .agg(F.sum("times").alias("c"), F.min(F.struct("key", "first", "n")).alias("one")))
    contents = materialise(contents.select("symbol", "content", (F.col("c") == 1).alias("once"), "one.*"))
    # (what repeats within its own text is known already)
    others = found.filter("times = 1")
    whole = others.filter("not mixed").select("key", "first", "n").unionByName(
        others.filter("mixed").select("symbol", "content", "key", "first", "n")
        .join(contents.filter("not once").select("symbol", "content"), ["symbol", "content"]).select("key", "first", "n"))
    whole = whole.unionByName(parsed.select("key", F.explode("own").alias("s")).select("key", "s.first", "s.n"))
    # 3. one stretch of each content of a mixed symbol, window by window
    stretch = F.struct("symbol", "first", "n", "once")
    listed = contents.groupBy("key").agg(F.collect_list(stretch).alias("compare"))
    touched = found.select("key").unionByName(parsed.filter("size(own) > 0").select("key")).distinct().join(listed, "key", "left")
    # (rows of equal id and text are one text here; their symbols were counted row by row)
    texts = materialise(source.select("key", "text").dropDuplicates(["key"]).join(touched, "key"))
    windows = materialise(_windows(texts.filter("compare is not null"), window))
    twice = windows.groupBy("symbol", "hash").agg(F.count("*").alias("c")).filter("c > 1").select("symbol", "hash")
    single = windows.filter("once").join(twice, ["symbol", "hash"]).select("key", "first", F.lit(1).alias("n"))
    # 4. the ranges to cut, by text
    spans = materialise(whole.unionByName(single).distinct().groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("spans")))
    release(found, contents, windows)
    return texts, spans


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.withColumn("key", F.xxhash64(F.col(id_column).cast("string"), F.lit("\t"), F.col(text_column)))


def dedupe(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows cut out of the texts; untouched texts stay as they are."""
    _, cuts = repeats(docs, id_column, text_column, window)
    cuts = cuts.select(F.col("key").alias("__key"), F.col("kept_text").alias("__kept"))
    key = F.xxhash64(F.col(id_column).cast("string"), F.lit("\t"), F.col(text_column))
    joined = docs.withColumn("__key", key).join(cuts, "__key", "left")
    return joined.select(*[F.coalesce("__kept", f"`{c}`").alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    rows, cuts = repeats(docs)
    return rows.join(cuts.drop("kept_text"), "key", "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
