"""Shared helpers: table reading, shared-storage materialisation and vectorised
word handling over Arrow string buffers.

Texts are handled as UTF-8 bytes straight from Arrow, a few megabytes at a
time, so no task holds a partition and no Python string is made per word.
"""

from __future__ import annotations

import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from railyard.session import ensure_checkpoint_dir

#: Bytes of text handled at once inside a task (a longer text is a piece of its own).
SLICE_BYTES = 2 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reachable(query: Callable) -> Callable:
    """The query, with this package's folder on the Python path of the workers
    (where the package isn't installed, as in a checkout)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, root])
        return query(spark, *args)

    return run


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and
    read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Delete the files of materialised frames of which everything that was
    derived has been materialised in turn, and let Spark drop the shuffle files
    of frames that are garbage by now."""
    for df in written:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


# --- Arrow text columns -----------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets into them starting at 0, null mask) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
        kind = np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    null = np.zeros(n, bool) if column.null_count == 0 else ~np.asarray(column.is_valid())
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0], null


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes of text at most."""
    _, off, _ = text_bytes(batch.column(column))
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


# --- words --------------------------------------------------------------------


def byte_table(chars: bytes) -> np.ndarray:
    """Boolean table by byte: True for the listed separator bytes."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Fixed: white space that separates words in ``[^\x20\x09-\x0D]+``.
SPACE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))


def word_spans(raw: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word and, per row, the index of its first
    word (one more entry than rows). Words never cross rows."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


# --- hashing --------------------------------------------------------------------
# A word's hash is a polynomial over its bytes modulo 2**64 (each byte first
# mapped to a random 64-bit value), taken from prefix sums, then mixed. The
# hash of a range of words is the same over mixed word hashes.

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**position, for :func:`range_hash`."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), equal for equal sequences anywhere."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + mix((end - start).astype(U64) + U64(0x51ED27)))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(prefix(_BYTES[raw]), start, end)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i], start[i] + 1, ... (count[i] values each)."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return at + np.arange(total)


def fields(*pairs: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in pairs])


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
