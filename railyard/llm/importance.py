"""Target-distribution importance resampling (operator 13).

Texts are lower-cased (A-Z) and cut into words; the CRC-32 of every word is
carried on over the words after it to the runs of 2, .. ``orders`` words, and
all are counted modulo ``buckets``. A document's counts (at
most ``buckets`` entries) are written once; sums over all documents and over
the target give a gain per bucket, and the gains (one number a bucket, a fixed
bound) go back to the tasks for the weights. Ranks are dealt by range: sorted
ranges with offsets, so no task sees all documents.

Defined results: a null, empty or word-less text has no features and weight 0;
a null id is hashed as an empty text and sorts after all others; repeated rows
count and rank one by one; an empty target leaves every gain to the documents'
counts; an empty table gives no rows. Extra columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.llm.common import batch_of, fields, materialise, slices, text_bytes
from railyard.operators.ordered import dense_ordinal

BUCKETS = 10_000
ORDERS = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Words whose features are counted at once, so that a very long text needs no list of all of them.
BLOCK = 1 << 17

#: Fixed: separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` become spaces, A-Z lower case.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def scanner(orders: int = ORDERS) -> Callable[[list[bytes], int], list[list[int]]]:
    """Function of words and a number n: the CRC-32 of all runs of 1 .. ``orders``
    words that start at the first n; a run's goes on from that of the run one word shorter."""

    def scan(words: list[bytes], n: int) -> list[list[int]]:
        added = [b" " + w for w in words]
        found = [list(map(crc32, words[:n]))]
        for k in range(1, orders):
            found.append(list(map(crc32, added[k:], found[-1])))
        return found

    scan.orders = orders
    return scan


def features(raw: bytes, scan: Callable[[list[bytes], int], list[list[int]]], buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, distinct buckets ascending, counts) of one text's UTF-8 bytes."""
    words = raw.translate(_NORMAL).split()
    total = np.zeros(buckets, np.int64) if len(words) > BLOCK else None
    for start in range(0, len(words) or 1, BLOCK):
        found = scan(words[start : start + BLOCK + scan.orders - 1], BLOCK)
        block = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found))) % buckets
        if total is None:
            return (len(words), *np.unique(block, return_counts=True))
        total += np.bincount(block, minlength=buckets)
    at = np.flatnonzero(total)
    return len(words), at, total[at]


def _counted(docs: DataFrame, text_column: str, keep: list[str], orders: int, buckets: int) -> DataFrame:
    """The columns in ``keep`` (as ``row``), words, and the counts of each text, written once."""
    shown = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([shown.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(orders)
        for whole in batches:
            for part in slices(whole, "text"):
                raw, off, _ = text_bytes(part.column("text"))
                rows = [features(raw[s:e].tobytes(), scan, buckets) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                # buckets as steps, which compress well
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([np.diff(r[1], prepend=0).astype(np.uint32).tobytes() for r in rows], pa.binary()),
                    pa.array([r[2].astype(np.uint32).tobytes() for r in rows], pa.binary())], names=["row", "n_words", "at", "n"])

    return materialise(shown.mapInArrow(run, schema))


def _totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: one dense vector a task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
                total[np.cumsum(np.frombuffer(at, np.uint32))] += np.frombuffer(n, np.uint32)
        yield batch_of(fields(("bucket", pa.int64()), ("n", pa.int64())), np.arange(buckets), total)

    out = np.zeros(buckets, np.int64)
    for r in counted.select("at", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    up, down = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * up / ((s + 1.0) * down))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(ident: object, seed: int = SEED) -> int:
    """The Gumbel draw of one id in thousandths, from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def annotate(docs: DataFrame, target: DataFrame, text_column: str = "text", id_column: str = "doc_id", target_text: str = "text",
             keep: list[str] | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS,
             buckets: int = BUCKETS, seed: int = SEED, name: str = "importance") -> DataFrame:
    """``docs`` (the columns in ``keep``, or all) plus a struct column ``name``:
    n_words, n_features, weight, score and rank. Rank is 1, 2, .. over the
    floor(percent * N / 100) highest scores of the N rows of at least
    ``least_words`` words, and null elsewhere. An input column of that name is
    replaced."""
    columns = [c for c in dict.fromkeys([*(docs.columns if keep is None else keep), id_column]) if c != name]
    counted = _counted(docs, text_column, columns, orders, buckets)
    aim = _counted(target, target_text, [target_text], orders, buckets)
    gain = gains(_totals(counted, buckets), _totals(aim, buckets))
    numbers = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")])
    schema = T.StructType([counted.schema["row"], *numbers.fields])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, weight = [], []
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
                n = np.frombuffer(n, np.uint32).astype(np.int64)
                many.append(int(n.sum()))
                weight.append(int((gain[np.cumsum(np.frombuffer(at, np.uint32))] * n).sum()))
            ids = batch.column("row").field(id_column).to_pylist()
            score = [w + noise(i, seed) for w, i in zip(weight, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_words"), *(pa.array(v, pa.int64()) for v in (many, weight, score))],
                                             names=["row", *numbers.names])

    scored = counted.mapInArrow(weigh, schema)
    ident = F.col("row")[id_column]
    able = scored.where(F.col("n_words") >= least_words).withColumn("down", -F.col("score")).withColumn("last", ident.isNull()).withColumn("id", ident)
    drawn = percent * counted.where(F.col("n_words") >= least_words).count() // 100
    ranked = dense_ordinal(able, [], ["down", "last", "id", "weight", "n_features"], name="place")
    ranked = ranked.select("row", *numbers.names, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(*[F.col("row")[c].alias(c) for c in columns], F.struct(*numbers.names, "rank").alias(name))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``."""
    name = "__importance"
    return annotate(docs, target, name=name, **options).where(F.col(name)["rank"].isNotNull()).drop(name)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return annotate(docs, benchmark, keep=["doc_id"]).select("doc_id", *[F.col("importance")[c].alias(c) for c in ("n_features", "weight", "score", "rank")])


def _crc_step() -> str:
    """SQL of one byte's step of CRC-32: the table is linear, so it is the sum of its entries at the byte's bits."""
    step = "crc >> 8"
    for k in range(8):
        entry = 1 << k
        for _ in range(8):
            entry = entry >> 1 ^ (entry & 1) * 0xEDB88320
        step = f"xor({step}, (xor(crc, b) >> {k} & 1) * {entry})"
    return step


DIGEST_SQL = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
listed AS (SELECT side, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS (SELECT side, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM listed),
runs AS (SELECT side, doc_id, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY side, doc_id ORDER BY i)),
grams AS (
  SELECT side, doc_id, word AS gram FROM runs UNION ALL SELECT side, doc_id, word || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT side, doc_id, word || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
names AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)),
coded AS (
  SELECT gram, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                                           lambda crc, b: {_crc_step()})) % 10000 AS bucket FROM names),
counts AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 't') AS t FROM grams JOIN coded USING (gram) GROUP BY bucket),
sums AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, sums),
weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM grams JOIN coded USING (gram) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM listed LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
placed_rows AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM placed_rows
"""
