"""Line dedup (operator 11).

Every line has a 128-bit hash of its key (stripped, A-Z lower-cased). The
distinct hashes that at least two documents hold are cut into shards, and each
shard is a minimal perfect hash: levels of bit arrays in which a key takes the
first position it alone falls on, the rank of its bit being its slot in three
arrays (64-bit fingerprint, count of rows, smallest document id). Documents
are cut into chunks; a chunk asks each shard once for its distinct hashes, so
a line that a third of all documents hold costs one entry a chunk, and shards
answer from their arrays. Lines themselves are never joined or shuffled.

Defined results: a null or empty text is one empty line (null becomes empty);
keys under ``least_chars`` code points are never dropped; a null id counts as
one document with the largest possible id; rows of equal id are one document,
so all of them keep the lines that this document owns; a text that loses all
its lines becomes empty; an empty table gives no rows. Extra columns pass
through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from railyard.llm.common import SPACE, U64, batch_of, fields, materialise, mix, slices, text_bytes

LEAST_CHARS = 10
#: Repeated lines in one shard (its arrays take about 21 bytes a line), and questions to one shard.
SHARD_KEYS = 1 << 16
SHARD_QUESTIONS = 1 << 20
#: Positions a level offers for each key still without one.
ROOM = 2.0

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_NO_ID = (1 << 63) - 1
_STEP = 0x9E3779B97F4A7C15

KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


# --- minimal perfect hash ---------------------------------------------------


def _position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a ^ mix(b + U64((level + 1) * _STEP % (1 << 64)))) % U64(size)).astype(np.int64)


def perfect_hash(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level sizes, bits of all levels, slot of every key) for distinct keys (a, b)."""
    rest, sizes, levels, found = np.arange(len(a)), [], [], np.zeros(len(a), np.int64)
    base = 0
    while len(rest):
        size = max(64, int(ROOM * len(rest)))
        at = _position(a[rest], b[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        found[rest[placed]] = base + at[placed]
        rest = rest[~placed]
        sizes.append(size)
        levels.append(alone)
        base += size
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return np.array(sizes, np.int64), bits, (np.cumsum(bits)[found] - 1 if len(a) else found)


def slots(sizes: np.ndarray, bits: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slot of every key, or -1 where no level has its bit; a key outside the
    hashed set may get any slot, which its fingerprint then refutes."""
    out = np.full(len(a), -1, np.int64)
    rest, base = np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        at = base + _position(a[rest], b[rest], level, int(size))
        hit = bits[at]
        out[rest[hit]] = rank[at[hit]] - 1
        rest = rest[~hit]
        base += int(size)
    return out


# --- lines --------------------------------------------------------------------


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(start, end, lines of each row) of the \n-split lines of every row."""
    breaks = np.flatnonzero(raw == 10)
    count = np.diff(np.searchsorted(breaks, off)) + 1
    last = np.cumsum(count) - 1
    inner = np.ones(int(count.sum()), bool)
    inner[last] = False
    start, end = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
    end[inner], end[last] = breaks, off[1:]
    start[last - count + 1] = off[:-1]
    start[np.flatnonzero(inner) + 1] = breaks + 1
    return start, end, count


def line_keys(raw: np.ndarray, off: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(16 hash bytes of every line's key, all zero for a short key; lines of each row)."""
    start, end, count = line_spans(raw, off)
    solid = np.flatnonzero(~SPACE[raw]) if len(raw) else np.zeros(0, np.int64)
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    some = np.flatnonzero(b > a)
    first, behind = solid[a[some]], solid[b[some] - 1] + 1
    long = chars[behind] - chars[first] >= least_chars
    out = np.zeros((len(start), 16), np.uint8)
    low = raw.tobytes().translate(_LOWER)
    digests = b"".join([xxh3_128_digest(low[s:e]) for s, e in zip(first[long].tolist(), behind[long].tolist())])
    out[some[long]] = np.frombuffer(digests, np.uint8).reshape(-1, 16)
    return out, count


def _pairs(keys: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of concatenated 16-byte hashes."""
    both = np.frombuffer(keys, U64) if isinstance(keys, bytes) else np.ascontiguousarray(keys).view(U64).ravel()
    return both[0::2], both[1::2]


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by (a, b), first place of every distinct pair in that order)."""
    order = np.lexsort((b, a))
    if not len(order):
        return order, order
    a, b = a[order], b[order]
    return order, np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))


# --- stages ---------------------------------------------------------------------


def _chunked(docs: DataFrame, text_column: str, id_column: str, keep: list[str], least_chars: int) -> DataFrame:
    """Rows written with the chunk they belong to and the hashes of their lines."""
    shown = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
                        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_NO_ID)).alias("id"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), *shown.schema.fields, T.StructField("keys", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for part in slices(whole, "text"):
                raw, off, _ = text_bytes(part.column("text"))
                keys, count = line_keys(raw, off, least_chars)
                ends = np.cumsum(count) * 16
                flat = keys.tobytes()
                column = pa.array([flat[e - 16 * int(n) : e] for e, n in zip(ends.tolist(), count)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, chunk)), *part.columns, column], names=["chunk", *part.schema.names, "keys"])
                chunk += 1

    return materialise(shown.mapInArrow(run, schema))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, lowest id, highest id, rows) of every distinct hash of a batch."""
    out = fields(("a", pa.int64()), ("b", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64()))
    for batch in batches:
        per_row = [np.unique(np.frombuffer(k, "V16")) for k in batch.column("keys").to_pylist()]
        if not per_row:
            continue
        a, b = _pairs(np.concatenate(per_row).tobytes())
        ids = np.repeat(np.asarray(batch.column("id")), [len(k) for k in per_row])
        real = (a | b) != 0
        a, b, ids = a[real], b[real], ids[real]
        order, first = _groups(a, b)
        if len(first):
            a, b, ids = a[order], b[order], ids[order]
            yield batch_of(out, a[first].view(np.int64), b[first].view(np.int64), np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first),
                           np.diff(np.append(first, len(a))))


def _shard_row(rows: pa.Table) -> pa.Table:
    """One shard: its perfect hash and the arrays that the slots index."""
    a, b = (np.ascontiguousarray(rows.column(c).to_numpy()).view(U64) for c in "ab")
    sizes, bits, slot = perfect_hash(a, b)
    prints, counts, owners = np.empty(len(a), U64), np.empty(len(a), np.uint32), np.empty(len(a), np.int64)
    prints[slot], counts[slot], owners[slot] = b, np.minimum(rows.column("n").to_numpy(), 0xFFFFFFFF), rows.column("low").to_numpy()
    return pa.table({"shard": rows.column("shard").slice(0, 1), "sizes": [sizes.tolist()], "bits": [np.packbits(bits).tobytes()],
                     "prints": [prints.tobytes()], "counts": [counts.tobytes()], "owners": [owners.tobytes()]})


INDEX = "shard long, sizes array<long>, bits binary, prints binary, counts binary, owners binary"


def build_index(chunks: DataFrame, shard_keys: int = SHARD_KEYS, shard_questions: int = SHARD_QUESTIONS) -> tuple[DataFrame, int]:
    """(one row a shard, number of shards) over the distinct line hashes that
    rows of at least two ids hold, written to the shared folder."""
    held = chunks.select("id", "keys").mapInArrow(_held, "a long, b long, low long, high long, n long")
    repeated = materialise(held.groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low <> high"))
    questions = chunks.agg(F.sum(F.octet_length("keys") / 16)).first()[0] or 0
    n = max(1, -(-repeated.count() // shard_keys), -(-int(questions) // shard_questions))
    rows = repeated.select(F.pmod("a", F.lit(n)).alias("shard"), "a", "b", "low", "n")
    return materialise(rows.groupBy("shard").applyInArrow(_shard_row, INDEX)), n


class _Shard:
    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes, owners: bytes) -> None:
        self.sizes = np.array(sizes, np.int64)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(self.sizes.sum())).astype(bool)
        self.rank = np.cumsum(self.bits)
        self.prints, self.counts, self.owners = np.frombuffer(prints, U64), np.frombuffer(counts, np.uint32), np.frombuffer(owners, np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys that the shard holds, their slots)."""
        slot = slots(self.sizes, self.bits, self.rank, a, b)
        known = np.flatnonzero(slot >= 0)
        known = known[self.prints[slot[known]] == b[known]]
        return known, slot[known]


def _answers(chunks: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(chunk, found): 24 bytes (hash, owner) for every repeated line of a chunk, in parts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fields(("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()))
        for batch in batches:
            of = np.asarray(batch.column("chunk"))
            for chunk in np.unique(of):
                keys = b"".join(batch.column("keys").filter(pa.array(of == chunk)).to_pylist())
                a, b = _pairs(np.unique(np.frombuffer(keys, "V16")).tobytes())
                real = (a | b) != 0
                a, b = a[real], b[real]
                shard = np.mod(a.view(np.int64), n)
                order = np.argsort(shard, kind="stable")
                flat = np.stack([a[order], b[order]], 1).tobytes()
                shards, first = np.unique(shard[order], return_index=True)
                ends = np.append(first[1:], len(a))
                yield batch_of(out, shards, np.full(len(shards), chunk), [flat[16 * s : 16 * e] for s, e in zip(first.tolist(), ends.tolist())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fields(("chunk", pa.int64()), ("found", pa.binary()))
        at, shard = None, None
        for batch in batches:
            chunks_, found = [], []
            for row in batch.to_pylist():
                if row["sizes"] is not None:
                    at, shard = row["shard"], _Shard(*(row[c] for c in ("sizes", "bits", "prints", "counts", "owners")))
                elif row["shard"] == at:
                    a, b = _pairs(row["keys"])
                    known, slot = shard.find(a, b)
                    if len(known):
                        chunks_.append(row["chunk"])
                        found.append(np.stack([a[known], b[known], shard.owners[slot].view(U64)], 1).tobytes())
            yield batch_of(out, chunks_, found)

    questions = chunks.select("chunk", "keys").mapInArrow(ask, "shard long, chunk long, keys binary")
    # a shard's row comes before the questions to it; rows of both stream through the task
    rows = questions.unionByName(index, allowMissingColumns=True).repartition(n, "shard").sortWithinPartitions("shard", F.col("sizes").isNull())
    return rows.mapInArrow(answer, "chunk long, found binary")


def dedupe(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", keep: list[str] | None = None, least_chars: int = LEAST_CHARS,
           shard_keys: int = SHARD_KEYS, shard_questions: int = SHARD_QUESTIONS, name: str = "lines") -> DataFrame:
    """``docs`` (the columns in ``keep``, or all) with repeated lines dropped
    everywhere but in the document of the smallest id, and a struct column
    ``name`` of n_lines (before dropping) and n_dropped. Ids are integers. An
    input column of that name is replaced."""
    columns = [c for c in dict.fromkeys([*(docs.columns if keep is None else keep), id_column, text_column]) if c != name]
    others = [c for c in columns if c != text_column]
    chunks = _chunked(docs, text_column, id_column, others, least_chars)
    index, n = build_index(chunks, shard_keys, shard_questions)
    answers = _answers(chunks, index, n)
    schema = T.StructType([chunks.schema["row"], T.StructField("text", T.StringType()), T.StructField("lines", KEPT)])

    def apply(rows: pa.Table, found: pa.Table) -> pa.Table:
        flat = b"".join(found.column("found").to_pylist())
        owner = {flat[i : i + 16]: int.from_bytes(flat[i + 16 : i + 24], "little", signed=True) for i in range(0, len(flat), 24)}
        texts, counts = [], []
        for text, keys, own in zip(rows.column("text").to_pylist(), rows.column("keys").to_pylist(), rows.column("id").to_pylist()):
            n_lines = len(keys) // 16
            stays = [owner.get(keys[i : i + 16], own) == own for i in range(0, len(keys), 16)]
            dropped = n_lines - sum(stays)
            texts.append("\n".join(compress(text.split("\n"), stays)) if dropped else text)
            counts.append({"n_lines": n_lines, "n_dropped": dropped})
        kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64())])
        return pa.table({"row": rows.column("row"), "text": pa.array(texts, pa.string()), "lines": pa.array(counts, kind)})

    kept = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, schema)
    shown = {c: F.col("text") if c == text_column else F.col("row")[c] for c in columns}
    return kept.select(*[v.alias(c) for c, v in shown.items()], F.col("lines").alias(name))


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return dedupe(docs, keep=["doc_id"]).select("doc_id", F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_dropped").alias("n_dropped"),
                                                F.sha2(F.col("text"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
held AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (key) GROUP BY doc_id
"""
