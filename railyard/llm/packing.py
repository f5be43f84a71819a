"""Packing along a space-filling curve (operator 7).

Every document is tokenized once. Its token counts, hashed into a signed vector
of ``VECTOR`` places, are projected to ``DIMS`` dimensions; the Hilbert key of
the projection is the order in which documents are range-sorted, so documents
near each other along the curve are alike. Each range is packed in that order
into sequences of ``LENGTH`` tokens, cutting documents where a sequence is full.
What is left at the end of a range is cut into sequences of power-of-two
lengths, so no sequence needs padding.

Copies have equal keys; a hash of id and text breaks the ties, so a large group
of copies is cut over ranges like any other rows. Tokens travel as 16-bit ids.

Defined results: null and empty texts are their end token alone; special-token
strings in a text are ordinary text; repeated rows are packed each; an empty
table gives no rows; rows with a null id keep it.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from railyard.llm.common import SPACE, batch_of, materialise, slices, text_bytes

LENGTH = 2048
END_ID = 1
VECTOR, DIMS, BITS = 64, 3, 16
#: Words whose ids a task remembers (some 60 MB).
REMEMBERED = 400_000
#: Bytes of text tokenized at once: a worker needs some fifty times that for its arrays and word lists.
SLICE = 1 << 20
#: Of these, the frequent words of its first texts are looked up first.
FREQUENT = 40_000


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, literal: bool) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = literal
    return t


#: Byte classes: white space, letter a-z, digit, other ASCII, apostrophe, beyond ASCII.
_BLANK, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _HIGH = range(6)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[SPACE] = _BLANK
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _APOSTROPHE
_CLASS[128:] = _HIGH
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[SPACE] = 0x20
#: Two neighbouring bytes between which the tokenizer always cuts.
_CUT = np.zeros((6, 6), bool)
for _a, _b in ((_LETTER, _MARK), (_LETTER, _DIGIT), (_DIGIT, _MARK)):
    _CUT[_a, _b] = _CUT[_b, _a] = True
_CUT[_DIGIT, _DIGIT] = True
_CUT = _CUT.ravel()


class WordIds:
    """Token ids of texts whose tokenizer lower-cases, drops white space and cuts
    letters, single digits and other characters apart before it merges (as the
    file used here does): ids are found once per distinct word.

    Texts are lower-cased and cut in ASCII, all rows at once; what touches an
    apostrophe or a byte beyond ASCII is left whole for the tokenizer to cut.
    New words are encoded together, a digit between them as a mark; words with
    digits or ``<|`` are encoded by themselves."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.remembered = tokenizer(path, True), remembered
        self.known: dict[bytes, bytes] = {}
        self.frequent: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode("0", add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the tokenizer has no token for a digit")
        self.mark = mark[0]

    def learn(self, words: list[bytes]) -> None:
        text = [w.decode() for w in words]
        plain = [i for i, w in enumerate(text) if w.isalpha()]
        for i, e in zip(plain_groups := [plain[k : k + 200] for k in range(0, len(plain), 200)],
                        self.tokenizer.encode_batch_fast([" 0 ".join(text[i] for i in g) for g in plain_groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u2")
            at = np.append(np.flatnonzero(ids == self.mark), len(ids))
            begin = np.append(0, at[:-1] + 1)
            for j, x, y in zip(i, begin.tolist(), at.tolist(), strict=True):
                self.known[words[j]] = ids[x:y].tobytes()
        rest = sorted(set(range(len(text))).difference(plain))
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([text[i] for i in rest], add_special_tokens=False)):
            self.known[words[i]] = np.array(e.ids, "<u2").tobytes()

    def ids(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The ids of every row, as little-endian 16-bit numbers."""
        if not len(raw):
            return [b""] * (len(off) - 1)
        kind = _CLASS[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
        cut[off] = True
        cuts = np.cumsum(cut, dtype=np.int64)
        spaced = np.full(len(raw) + int(cuts[-1]), 0x20, np.uint8)
        spaced[np.arange(len(raw)) + cuts[:-1]] = _LOWER[raw]
        inside = spaced != 0x20  # a row starts with a blank
        bound = np.searchsorted(np.flatnonzero(inside[1:] & ~inside[:-1]), off + cuts[off] - 1)
        words = spaced.tobytes().split()
        # the frequent words first, in a table small enough to stay near the processor
        found = list(map(self.frequent.get, words))
        rest = [i for i, x in enumerate(found) if x is None]
        for i in rest:
            found[i] = self.known.get(words[i])
        rest = [i for i in rest if found[i] is None]
        if rest:
            fresh = {words[i] for i in rest}
            if len(self.known) + len(fresh) > self.remembered:
                self.known.clear()
            self.learn(list(fresh))
            for i in rest:
                found[i] = self.known[words[i]]
        if len(self.frequent) < FREQUENT:
            ids_of = dict(zip(words, found))
            self.frequent |= {w: ids_of[w] for w, _ in Counter(words).most_common(FREQUENT - len(self.frequent))}
        return [b"".join(found[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The table of a Python worker, kept from task to task."""
    return WordIds(path)


def projections(ids: list[np.ndarray], size: int, seed: int = 3) -> np.ndarray:
    """(rows, DIMS) projections of the hashed, length-normalised token counts."""
    place, sign, matrix = _hashing(size, seed)
    n = np.array([len(x) for x in ids])
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(ids)), n)
    vector = np.bincount(row * VECTOR + place[flat], sign[flat], len(ids) * VECTOR).reshape(len(ids), VECTOR)
    return (vector / np.maximum(n, 1)[:, None]) @ matrix


@functools.lru_cache(maxsize=2)
def _hashing(size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, VECTOR, size), rng.choice([-1.0, 1.0], size), rng.normal(0, 1, (VECTOR, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows, dims) with ``bits`` bits each:
    axes are untangled from the highest bit down, then Gray-decoded and interleaved."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | ((x[i] ^ turn) >> b & 1)
    return out


def _tokenized(docs: DataFrame, path: str) -> DataFrame:
    schema = T.StructType([docs.schema["id"], T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType()),
                           *[T.StructField(f"p{i}", T.DoubleType()) for i in range(DIMS)]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        size = words.tokenizer.get_vocab_size()
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                raw, off, _ = text_bytes(part.column("text"))
                ids = words.ids(raw, off)
                at = projections([np.frombuffer(x, "<u2") for x in ids], size)
                yield batch_of(arrow, part.column("id"), part.column("tie"), ids, *at.T)

    return docs.mapInArrow(run, schema)


class Packer:
    """Fills sequences in order; pieces are (document, start, ids, sequence, offset)."""

    def __init__(self, length: int = LENGTH):
        self.length, self.sequence, self.fill = length, 0, 0
        self.open: list[tuple] = []  # pieces of the sequence being filled: (document, start, ids)

    def add(self, document, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            n = min(self.length - self.fill, len(ids) - start)
            self.open.append((document, start, ids[start : start + n]))
            self.fill += n
            start += n
            if self.fill == self.length:
                yield from self._close(self.open)
                self.open, self.fill = [], 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for document, start, ids in pieces:
            yield document, start, ids, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences of falling powers of two."""
        rest, room, now = list(self.open), 0, []
        while rest:
            if not room:
                room = 1 << (sum(len(p[2]) for p in rest).bit_length() - 1)
            document, start, ids = rest.pop(0)
            now.append((document, start, ids[:room]))
            if len(ids) > room:
                rest.insert(0, (document, start + room, ids[room:]))
            room -= len(now[-1][2])
            if not room:
                yield from self._close(now)
                now = []
        self.open, self.fill = [], 0


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for.

    ``path`` is the tokenizer file, installed alike on every executor; its ids must fit 16 bits.
    """
    if tokenizer(path, False).get_vocab_size() > 1 << 16:
        raise ValueError("ids do not fit 16 bits")
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    source = source.withColumn("tie", F.xxhash64(F.col("id").cast("string"), F.lit("\t"), "text"))
    tokens = materialise(_tokenized(source, path))
    stats = tokens.agg(*[f(f"p{i}").alias(f"{n}{i}") for i in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    middle, spread = (np.array([stats[f"{n}{i}"] or 0.0 for i in range(DIMS)]) for n in "ms")
    spread = np.maximum(spread, 1e-12)

    @F.pandas_udf(T.LongType())
    def curve(*p):
        z = (np.column_stack(p) - middle) / spread
        unit = 1 / (1 + np.exp(-1.702 * np.clip(z, -9, 9)))  # about the normal distribution's share below z
        return type(p[0])(hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    keyed = tokens.select("id", "tie", "ids", curve(*[f"p{i}" for i in range(DIMS)]).alias("curve"))
    ordered = keyed.repartitionByRange("curve", "tie").sortWithinPartitions("curve", "tie")
    fields = [docs.schema[id_column], *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    schema = T.StructType([T.StructField("id", fields[0].dataType), *fields[1:], *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(length), TaskContext.get().partitionId() << 36

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            ids = [p[2] for p in pieces]
            columns = [pa.array([p[0][0] for p in pieces], arrow.field(0).type), [p[1] for p in pieces], [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids],
                       [p[0][1] for p in pieces], [base + p[3] for p in pieces], [p[4] for p in pieces]]
            return batch_of(arrow, *columns, *([[x.astype(np.int32) for x in ids]] if with_ids else []))

        done: list[tuple] = []
        for batch in batches:
            for doc, raw in zip(batch.column("id").to_pylist(), batch.column("ids")):
                ids = np.append(np.frombuffer(raw.as_buffer(), "<u2").astype("<u4"), np.array([end_id], "<u4"))
                done.extend(packer.add((doc, len(ids)), ids))
                if len(done) >= 4096:
                    yield rows(done)
                    done = []
        done.extend(packer.finish())
        yield rows(done)

    return ordered.select("id", "ids").mapInArrow(run, schema).withColumnRenamed("id", id_column)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of the registered query."""
    return pack(docs, path, with_ids=False)
