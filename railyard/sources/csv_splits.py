"""CSV records in splits (SRC-01).

Spark's text reader cuts files into splits at line ends, but a quoted cell may
hold line ends, so a line says nothing about where a record starts. Three steps
find out without reading a file in one task:

1. every split is scanned under both assumptions, that it begins outside and
   that it begins inside quotes, and gives the state it ends in and the records
   that start in it under each;
2. these functions of two states are composed along each file by windows over
   one small row per split, which gives the state and record number every split
   really begins with;
3. the splits are parsed, each from its own state. A record that goes on in the
   next split leaves pieces, at most two per split, which are put together.

Headers are read from the first block of each file only: every file is one
partition there, and its reader stops after one line.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railyard.session import materialise, written

#: Larger than any file: a file is not split, and no two share a partition.
WHOLE_FILES = str(1 << 50)
BATCH_ROWS = 5000


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(f, header): the first line of every file that has one."""
    side = spark.newSession()
    side.conf.set("spark.sql.files.maxPartitionBytes", WHOLE_FILES)
    side.conf.set("spark.sql.files.openCostInBytes", WHOLE_FILES)
    side.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = side.read.text(list(paths)).select(F.col("_metadata.file_path").alias("f"), F.col("value").alias("header"))
    return spark.read.schema("f string, header string").parquet(written(lines.mapInArrow(one, "f string, header string"), spark))


def inside_after(line: str, inside: bool) -> bool:
    """Does the line end inside quotes, given how it begins?"""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:  # at the start of a cell: only there a quote opens
            if at < n and line[at] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('""', at):
            at += 2
            continue
        inside, at = False, line.find(",", at + 1) + 1
        if not at:
            return False


def _per_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[bool, str, pa.RecordBatch, int]]]]:
    """Lines with their split's key; ``first`` marks the first line of a split."""
    before = None
    for batch in batches:
        keys = list(zip(batch.column("f").to_pylist(), batch.column("b").to_pylist()))
        for i, (key, line) in enumerate(zip(keys, batch.column("value").to_pylist())):
            yield key, key != before, line, batch, i
            before = key


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _states(lines: DataFrame, multiline: bool) -> DataFrame:
    """Per split: the state after it and the records that start in it, by the state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f", "b", "out0", "out1", "n0", "n1"]
        at, state, n = None, [False, True], [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: [v] for c, v in zip(names, (*at, *state, *n))})

        for key, first, line, _, _ in _per_split(batches):
            if first:
                if at is not None:
                    yield row()
                at, state, n = key, [False, True], [0, 0]
            for k in (0, 1):
                if not state[k] and not _blank(line):
                    n[k] += 1
                state[k] = multiline and inside_after(line, state[k])
        if at is not None:
            yield row()

    return lines.mapInArrow(run, "f string, b long, out0 boolean, out1 boolean, n0 long, n1 long")


def _starts(states: DataFrame, parts: bool) -> DataFrame:
    """Per split: key, file, state and record number it begins with, and the state it ends in."""
    file = F.regexp_extract("f", r"^(.*)/", 1) if parts else F.col("f")
    s = states.select("*", file.alias("file"))
    before = Window.partitionBy("file").orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("f", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a split either sets the state, keeps it or turns it round
    sets, turns = F.col("out0") == F.col("out1"), (F.col("out0") & ~F.col("out1")).cast("int")
    s = s.withColumn("turned", F.sum(turns).over(upto))
    s = s.withColumn("set", F.when(sets, F.struct(F.col("out0").cast("int").alias("to"), F.col("turned").alias("at"))))
    last, turned = F.last("set", ignorenulls=True).over(before), F.coalesce(F.sum(turns).over(before), F.lit(0))
    s = s.withColumn("inside", (F.coalesce(last["to"], F.lit(0)) + turned - F.coalesce(last["at"], F.lit(0))) % 2 == 1)
    began = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    s = s.withColumn("began", began)
    return s.select("f", "b", "file", "inside", F.when(F.col("inside"), F.col("out1")).otherwise(F.col("out0")).alias("goes_on"),
                    F.coalesce(F.sum("began").over(before), F.lit(0)).alias("before"))


def _cells(text: str) -> list[list[str | None]]:
    return [[c or None for c in cells] for cells in csv.reader(io.StringIO(text, newline="")) if cells]


ROWS = "file string, f string, b long, row_num long, cells array<string>, piece string"


def _parsed(lines: DataFrame, multiline: bool) -> DataFrame:
    """Whole records (``cells``), and pieces of records that cross splits
    (``piece``; with ``row_num`` where the record starts)."""
    arrow = pa.schema([("file", pa.string()), ("f", pa.string()), ("b", pa.int64()), ("row_num", pa.int64()), ("cells", pa.list_(pa.string())), ("piece", pa.string())])

    def batch_of(file: str, key: tuple, numbers: list, cells: list, pieces: list) -> pa.RecordBatch:
        n = len(numbers)
        columns = ([file] * n, [key[0]] * n, [key[1]] * n, numbers, cells, pieces)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[str] = []  # lines of the records read since ``number``
        text: list[str] = []  # lines of the record at hand
        key = file = None
        inside = started = False
        number = n_whole = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, n_whole
            if whole:
                cells = _cells("\n".join(whole))
                yield batch_of(file, key, list(range(number, number + len(cells))), cells, [None] * len(cells))
                whole.clear()
            number, n_whole = number + n_whole, 0

        def close() -> Iterator[pa.RecordBatch]:
            """The end of a split: what is at hand goes on in the next one."""
            yield from flush()
            if text:
                yield batch_of(file, key, [number if started else None], [None], ["\n".join(text)])
                text.clear()

        for now, first, line, batch, i in _per_split(batches):
            if first:
                yield from close()
                key, file, inside, number = now, batch.column("file")[i].as_py(), batch.column("inside")[i].as_py(), batch.column("before")[i].as_py()
                started = not inside
                if now[1] == 0:
                    line = line.removeprefix("\ufeff")
            if not text and not inside and _blank(line):
                continue
            text.append(line)
            inside = multiline and inside_after(line, inside)
            if inside:
                continue
            if started:
                whole += text
                n_whole += 1
            else:  # the end of a record of an earlier split
                yield batch_of(file, key, [None], [None], ["\n".join(text)])
                started = True
            text.clear()
            if n_whole >= BATCH_ROWS:
                yield from flush()
        yield from close()

    return lines.mapInArrow(run, ROWS)


def _joined(pieces: DataFrame) -> DataFrame:
    """Records from their pieces: a piece with a number opens one, those after it belong to it."""
    order = ["f", "b", F.col("row_num").asc_nulls_first()]
    w = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = pieces.withColumn("n", F.max("row_num").over(w)).groupBy("file", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "b", F.col("row_num").isNotNull().alias("opens"), "piece"))), lambda p: p["piece"]), "\n").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, n, cells) for f, n, t in zip(*(batch.column(c).to_pylist() for c in ("file", "n", "text"))) for cells in _cells(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.string())))],
                                             names=["file", "row_num", "cells"])

    return grouped.mapInArrow(run, "file string, row_num long, cells array<string>")


def records(spark: SparkSession, paths: Sequence[str], multiline: bool = True, parts: bool = False) -> DataFrame:
    """(file, row_num, cells) of every record, the header being number 0. With
    ``parts`` the files of a folder, in the order of their names, are one file."""
    text = spark.read.option("lineSep", "\n").text(list(paths))
    lines = text.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    starts = materialise(_starts(_states(lines, multiline), parts))
    # one row of about a hundred bytes per split: the bound of this broadcast (and it must be one, as lines stay in order)
    known = lines.join(F.broadcast(starts), ["f", "b"])
    whole = _parsed(known, multiline).where("cells is not null").select("file", "row_num", "cells")
    crossing = F.col("inside") | F.col("goes_on")
    if not multiline or starts.where(crossing).isEmpty():
        return whole
    pieces = _parsed(known.where(crossing), multiline).where("piece is not null")
    return whole.unionByName(_joined(pieces))
