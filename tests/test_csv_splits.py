"""CSV in splits against Python's csv module over whole files."""

from __future__ import annotations

import csv
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from railyard.sources import csv_splits, tabular


def _write(path, rows, end="\n", bom=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as fh:
        if bom:
            fh.write("﻿")
        csv.writer(fh, lineterminator=end).writerows(rows)


def _cells(rng, n):
    words = ["", "x", "a,b", 'say "hi"', "two\nlines", 'q"\n"q', "\n\n", "ünï", "5 o'clock", ",", '"', "tail\n", "long " * 40]
    return [[str(i), rng.choice(words), rng.choice(words)] for i in range(n)]


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _expected(rows):
    return sorted((i, *[c or None for c in r]) for i, r in enumerate(rows))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_file_of_several_splits_reads_like_a_whole_file(spark, scratch, small_splits, end):
    rng = random.Random(6)
    rows = _cells(rng, 400)
    path = f"{scratch}/in/stops.csv"
    _write(path, [["id", "a", "b"], *rows], end, bom=True)
    df = tabular.read_csv_text(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    assert sorted((r.row_num, r.id, r.a, r.b) for r in df.collect()) == _expected(rows)
    assert {r._file.rsplit("/", 1)[1] for r in df.select("_file").distinct().collect()} == {"stops.csv"}


def test_records_longer_than_splits_and_unclosed_quotes(spark, scratch, small_splits):
    rows = [["1", "line\n" * 900, "x"], ["2", "y", "\n" * 3000 + "end"], ["3", "z", ""], ["4", 'in "quotes"\n' * 500, "w"]]
    _write(f"{scratch}/in/a.csv", [["id", "a", "b"], *rows])
    with open(f"{scratch}/in/b.csv", "w") as fh:
        fh.write('id,a\n7,5" pipe\n\n8,"never closed\n' + "more\n" * 400)
    got = sorted((r._file.rsplit("/", 1)[1], r.row_num, r.id, r.a, r.b) for r in tabular.read_csv_text(spark, f"{scratch}/in").collect())
    want = [("a.csv", *r) for r in _expected(rows)] + [("b.csv", 0, "7", '5" pipe', None), ("b.csv", 1, "8", "never closed\n" + "more\n" * 399 + "more", None)]
    assert [(*g[:3], (g[3] or "").rstrip("\n"), g[4]) for g in got] == [(*w[:3], (w[3] or "").rstrip("\n"), w[4]) for w in want]


def test_files_of_other_headers_and_folders_of_parts(spark, scratch, small_splits):
    rng = random.Random(7)
    one, two = _cells(rng, 60), _cells(rng, 50)
    _write(f"{scratch}/in/one.csv", [["id", "a", "b"], *one])
    _write(f"{scratch}/in/two.csv", [["b", "id", "id"], *two])
    open(f"{scratch}/in/empty.csv", "w").close()
    rows = tabular.read_csv_text(spark, f"{scratch}/in").collect()
    assert sorted((r.row_num, r.id, r.a, r.b) for r in rows if "one" in r._file) == _expected(one)
    assert sorted((r.row_num, r.b, r.id, r.id2) for r in rows if "two" in r._file) == _expected(two)
    with open(f"{scratch}/in/one.csv", newline="") as fh:
        text = fh.read()
    os.makedirs(f"{scratch}/parts/t=stops")
    cuts = [0, *(i + 1 for i in sorted(rng.sample([k for k, c in enumerate(text) if c == "\n"], 3))), len(text)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        with open(f"{scratch}/parts/t=stops/part-{k}.csv", "w", newline="") as fh:
            fh.write(text[a:b])
    df = tabular.read_csv_text(spark, f"{scratch}/parts/t=stops", parts=True)
    assert sorted((r.row_num, r.id, r.a, r.b) for r in df.collect()) == _expected(one)


def test_headers_come_from_first_blocks(spark, scratch):
    for k in range(3):
        _write(f"{scratch}/in/f{k}.csv", [["id", f"c{k}"], *([str(i), "x" * 50] for i in range(20_000))])
    heads = csv_splits.first_lines(spark, [f"{scratch}/in"])
    assert sorted(r.header for r in heads.collect()) == ["id,c0", "id,c1", "id,c2"]
    assert len(glob.glob(f"{scratch}/in/*")) == 3
    counts = tabular.read_csv_text(spark, f"{scratch}/in").groupBy("_file").agg(F.count("*").alias("n"), F.max("row_num").alias("m")).collect()
    assert [(r.n, r.m) for r in counts] == [(20_000, 19_999)] * 3


@pytest.mark.parametrize("line, inside, want", [("a,b", False, False), ('"a', False, True), ('a"b', False, False), ('"a""', False, True), ('"a""b",c', False, False),
                                               ('b",c', True, False), ('b"",c', True, True), ('x","', True, True), ("", True, True), ('"",""', False, False), (',"', False, True)])
def test_state_of_a_line(line, inside, want):
    assert csv_splits.inside_after(line, inside) is want
