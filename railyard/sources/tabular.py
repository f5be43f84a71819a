"""Delimited uploads, batch routing, Silver scans (SRC-01/02/07/08/09, PRJ-01/02/04/07/10).

Every column is read as text (types come from the schema, not inference), and
every file by its own header, so files of one read may differ in columns and
their order. Rows carry ``row_num``: the 0-based data record of their file, from
record counts per split and a prefix sum over one small row per split — never
from a sort or a single-task ``zipWithIndex``.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard import catalog, schemas
from railyard.functions import scalars as S
from railyard.schema import Schema
from railyard.sources import csv_splits

FEED = "feed_id"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path (or glob) name anything, in whatever file system it is?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _header_names(header: str) -> list[str]:
    """Column names of a header line; empty and repeated names get their place."""
    seen: set[str] = set()
    names = []
    for i, n in enumerate(next(csv.reader([header.lstrip("\ufeff").rstrip("\r")]), [])):
        names.append(n if n and n not in seen else f"{n or '_c'}{i}")
        seen.add(n)
    return names


def read_csv_text(spark: SparkSession, path: str | Sequence[str], multiline: bool = True, parts: bool = False) -> DataFrame:
    """SRC-01: CSV files with headers, all columns text (empty cells NULL), with
    file name and dense row_num; the columns are those of all headers.

    Files are read in splits (``csv_splits``). ``multiline`` takes line breaks
    inside quotes as part of the cell; without it a record is a line. ``parts``
    takes the files of a folder, in the order of their names, as one file with
    the header in the first (then ``_file`` is the folder)."""
    paths = [path] if isinstance(path, str) else list(path)
    heads = csv_splits.first_lines(spark, paths)
    if parts:
        heads = heads.groupBy(F.regexp_extract("f", r"^(.*)/", 1).alias("f")).agg(F.min_by("header", "f").alias("header"))
    # the distinct headers reach the driver, not the files
    layouts = [(r.header, names) for r in heads.select("header").distinct().orderBy("header").collect() if (names := _header_names(r.header))]
    if not layouts:
        raise FileNotFoundError(f"no file with a header under {path}")
    rows = csv_splits.records(spark, paths, multiline, parts).where("row_num > 0")
    if len(layouts) > 1:  # (one row a file; AQE broadcasts it if small)
        rows = rows.join(heads.withColumnRenamed("f", "file"), "file")
    places: dict[str, list[tuple[str, int]]] = {}
    for header, names in layouts:
        for i, n in enumerate(names):
            places.setdefault(n, []).append((header, i))

    def cell(found: list[tuple[str, int]]) -> Column:
        if len(layouts) == 1:
            return F.get("cells", F.lit(found[0][1]))
        place = F.coalesce(*[F.when(F.col("header") == h, F.lit(i)) for h, i in found])
        return F.when(place.isNotNull(), F.get("cells", place))

    return rows.select(*[cell(found).alias(n) for n, found in places.items()], F.col("file").alias("_file"), (F.col("row_num") - 1).alias("row_num"))


def normalize_headers(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """PRJ-01 + PRJ-02: snake_case header names, then the alias map."""
    keep = {"_file", "row_num", FEED}
    renamed = df.toDF(*[c if c in keep else S.normalize_header(c) for c in df.columns])
    if aliases:
        norm = {S.normalize_header(k): v for k, v in aliases.items()}
        renamed = renamed.withColumnsRenamed({k: v for k, v in norm.items() if k in renamed.columns})
    return renamed


def preview(df: DataFrame, aliases: Mapping[str, str] | None = None, rows: int = 10) -> DataFrame:
    """SRC-02: first rows of a normalised upload (the limit is the feature; the
    whole upload stays available as ``df``)."""
    return normalize_headers(df, aliases).orderBy("_file", "row_num").limit(rows)


def validate_upload(df: DataFrame, schema: Schema, mandatory: Sequence[str] | None = None,
                    aliases: Mapping[str, str] | None = None, keep: Sequence[str] = ()):
    """PRJ-07: (good rows, error rows, missing mandatory columns).

    ``mandatory`` switches to the relaxed schema (PRJ-06). Missing mandatory
    columns are found at plan time (PRJ-04) and returned as a list."""
    norm = normalize_headers(df, aliases)
    sch = schema.relaxed(mandatory) if mandatory is not None else schema
    missing = sch.missing_columns(norm.columns, mandatory)
    good, bad = sch.validate(norm, row_col="row_num", keep=[*keep, *(["_file"] if "_file" in norm.columns else [])])
    return good, bad, missing


def extra_and_missing_columns(df: DataFrame, table: str) -> tuple[list[str], list[str]]:
    """PRJ-10: columns of a direct CSV load that the GTFS table lacks / needs."""
    from railyard import schemas

    names = schemas.GTFS[table].names
    cols = [c for c in df.columns if c not in ("_file", "row_num", FEED)]
    return [c for c in cols if c not in names], [c for c in schemas.GTFS[table].required_names() if c not in cols]


def route_files(files: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """SRC-07: file name → GTFS table (``stops.txt``/``stops.csv`` → stops), per-file overrides first."""
    stem = F.regexp_extract(F.lower(F.col("file_name")), r"^(?:.*/)?([a-z_]+)\.(?:txt|csv)$", 1)
    known = F.when(stem.isin(*catalog.TABLES), stem)
    if overrides:
        ov = F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k), F.lit(v))])
        return files.withColumn("table_name", F.coalesce(F.try_element_at(ov, F.col("file_name")), known))
    return files.withColumn("table_name", known)


def batch_preview(spark: SparkSession, path: str, overrides: Mapping[str, str] | None = None,
                  max_files: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """SRC-08: per file — size, data records, target table, and problems
    (unknown table, duplicate target). Limits on the number and size of files
    are reported only if given; nothing is refused by size on its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,csv}").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("length").alias("size_bytes"))
    files = route_files(files, overrides)
    listed = f"{path}/*.{{txt,csv}}"
    records = read_csv_text(spark, listed).groupBy(F.regexp_extract("_file", r"([^/]+)$", 1).alias("file_name")).agg(
        F.count(F.lit(1)).alias("data_rows"))
    dup = files.where(F.col("table_name").isNotNull()).groupBy("table_name").agg(
        F.count_distinct("file_name").alias("_files")).where(F.col("_files") > 1).withColumn("_dup", F.lit(True))
    out = files.join(records, "file_name", "left").join(dup.select("table_name", "_dup"), "table_name", "left")
    found = [F.when(F.col("table_name").isNull(), F.lit("unknown table")), F.when(F.col("_dup"), F.lit("duplicate target table"))]
    if max_files is not None and files.count() > max_files:
        found.append(F.lit(f"more than {max_files} files"))
    if max_file_bytes is not None:
        found.append(F.when(F.col("size_bytes") > max_file_bytes, F.lit("file too large")))
    return out.select("file_name", "table_name", "size_bytes", F.coalesce("data_rows", F.lit(0)).alias("data_rows"),
                      F.array_compact(F.array(*found)).alias("problems"))


def load_batch(spark: SparkSession, path: str, feed_id: str, overrides: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """SRC-07: the rows of every routed file of a folder as GTFS tables in text
    columns, ready for ``GtfsStore.load``; a table named by two files gets the
    rows of both, files without a table are left out."""
    rows = normalize_headers(read_csv_text(spark, f"{path}/*.{{txt,csv}}"))
    rows = route_files(rows.withColumn("file_name", F.regexp_extract("_file", r"([^/]+)$", 1)), overrides)
    names = [r.table_name for r in rows.select("table_name").distinct().collect() if r.table_name]  # 15 at most
    out = {}
    for t in sorted(names):
        columns = [c for c in schemas.GTFS[t].names if c in rows.columns]
        out[t] = rows.where(F.col("table_name") == t).select(F.lit(feed_id).alias(FEED), "row_num", *columns)
    return out


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: Silver Parquet, or CSV text when the path is a CSV."""
    if path.lower().endswith(".csv"):
        return read_csv_text(spark, path)
    return spark.read.parquet(path)
