"""GTFS feed archives (ZIP) as distributed row sources (SRC-03..06, SRC-13, SRC-14).

``binaryFile`` lists and reads the archives; ``mapInArrow`` opens them where
they were read (a ZIP container has no Spark reader), streams each member's
text through a CSV reader and yields bounded batches of rows ``(feed_id,
member, table_name, row_num, keys, vals, reject)``. A member's header travels
once, in its ``row_num = -1`` row; the cells of a data row stand in the order
of the table's own columns. Everything after that — counts, previews, typing,
validation — is DataFrame work.

No archive is refused by its size or its number of members unless ``Limits``
are given.
"""

from __future__ import annotations

import csv
import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard import catalog, schemas

FEED = "feed_id"
BATCH_ROWS = 5000


@dataclass(frozen=True)
class Limits:
    """SRC-05: optional guards; archives and members beyond them become reject rows."""

    archive_bytes: int | None = None
    member_bytes: int | None = None
    members: int | None = None


ROW_SCHEMA = T.StructType([
    T.StructField(FEED, T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("row_num", T.LongType()),
    T.StructField("keys", T.ArrayType(T.StringType())),
    T.StructField("vals", T.ArrayType(T.StringType())),
    T.StructField("reject", T.StringType()),
])
_ARROW = pa.schema([
    pa.field(FEED, pa.string()), pa.field("member", pa.string()), pa.field("table_name", pa.string()),
    pa.field("row_num", pa.int64()), pa.field("keys", pa.list_(pa.string())), pa.field("vals", pa.list_(pa.string())),
    pa.field("reject", pa.string()),
])


def _note(feed_id: str, member: str | None = None, table: str | None = None, row_num: int | None = None,
          keys: list[str] | None = None, reject: str | None = None) -> pa.RecordBatch:
    """One row that carries no cells: a reject, an unknown member or a header."""
    cells = ([feed_id], [member], [table], [row_num], [keys], [None], [reject])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _ARROW)], schema=_ARROW)


def _member_rows(feed_id: str, member: str, table: str, fh, raw: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one member, read as a stream."""
    text = io.TextIOWrapper(fh, encoding="utf-8" if raw else "utf-8-sig", errors="strict" if raw else "replace", newline="")
    reader = csv.reader(text)
    names = [h if raw else h.strip() for h in next(reader, [])]
    yield _note(feed_id, member, table, -1, list(dict.fromkeys(names)))
    place = {n: j for j, n in enumerate(names)}  # of a repeated name the last column counts
    wanted = [place.get(c) for c in (schemas.GTFS[table].names if table in schemas.GTFS else names)]

    def cell(cells: list[str], j: int | None) -> str | None:
        if j is None or j >= len(cells):
            return None
        return cells[j] if raw else cells[j].strip() or None

    numbers: list[int] = []
    values: list[list[str | None]] = []

    def batch() -> pa.RecordBatch:
        n = len(numbers)
        columns = (pa.repeat(feed_id, n), pa.repeat(member, n), pa.repeat(table, n), pa.array(numbers, pa.int64()),
                   pa.nulls(n, _ARROW.field("keys").type), pa.array(values, _ARROW.field("vals").type), pa.nulls(n, pa.string()))
        return pa.RecordBatch.from_arrays(list(columns), schema=_ARROW)

    for i, cells in enumerate(reader):
        if cells:
            numbers.append(i)
            values.append([cell(cells, j) for j in wanted])
            if len(numbers) >= BATCH_ROWS:
                yield batch()
                numbers, values = [], []
    if numbers:
        yield batch()


def _archive_rows(feed_id: str, data, raw: bool, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Every row of one archive."""
    try:
        zf = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield _note(feed_id, reject="Not a valid ZIP archive")
        return
    infos = [i for i in zf.infolist() if not i.is_dir()]
    if limits.members is not None and len(infos) > limits.members:
        yield _note(feed_id, reject=f"Archive has {len(infos)} members (max {limits.members})")
        return
    big = [i.filename for i in infos if limits.member_bytes is not None and i.file_size > limits.member_bytes]
    if big:
        yield _note(feed_id, reject=f"Member {big[0]} exceeds {limits.member_bytes} bytes uncompressed")
        return
    seen: set[str] = set()
    for info in infos:
        name = posixpath.basename(info.filename).lower()
        if not name.endswith(".txt"):
            continue
        table = name[:-4]
        if not raw and table not in catalog.PRIMARY_KEYS:
            yield _note(feed_id, info.filename)
        elif table not in seen:  # of two members for one table the first counts
            seen.add(table)
            try:
                with zf.open(info) as fh:
                    yield from _member_rows(feed_id, info.filename, table, fh, raw)
            except UnicodeDecodeError:
                yield _note(feed_id, info.filename, table, reject="File is not valid UTF-8")


def scan_archives(spark: SparkSession, path: str, raw: bool = False, limits: Limits = Limits()) -> DataFrame:
    """All archives under ``path`` (``*.zip``); feed_id = archive file stem."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
             .load(path))
    return parse_files(files, raw, limits)


def parse_files(files: DataFrame, raw: bool = False, limits: Limits = Limits()) -> DataFrame:
    """Row stream of ``binaryFile`` rows (a batch or a micro-batch).

    Header rows have ``row_num = -1``; rejected archives/members carry
    ``reject``; unknown ``.txt`` members have a NULL table. The archives are
    parsed in the tasks that read them: their bytes are never shuffled."""
    feed = F.regexp_extract(F.col("path"), r"([^/]+)\.zip$", 1)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for feed_id, content in zip(batch.column(FEED), batch.column("content")):
                yield from _archive_rows(feed_id.as_py(), memoryview(content.as_buffer()), raw, limits)

    if limits.archive_bytes is None:
        return files.select(feed.alias(FEED), "content").mapInArrow(parse, ROW_SCHEMA)
    fits = F.col("length") <= limits.archive_bytes
    too_big = files.where(~fits).select(
        feed.alias(FEED), *[F.lit(None).cast(f.dataType).alias(f.name) for f in ROW_SCHEMA.fields[1:-1]],
        F.format_string("Archive is %d bytes (max %d)", F.col("length"), F.lit(limits.archive_bytes)).alias("reject"))
    return files.where(fits).select(feed.alias(FEED), "content").mapInArrow(parse, ROW_SCHEMA).unionByName(too_big)


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject").isNotNull()).select(FEED, "member", "reject")


def _cells(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """The data rows of one table; a column that the member lacks is NULL."""
    names = schemas.GTFS[table].names
    data = rows.where((F.col("table_name") == table) & (F.col("row_num") >= 0) & F.col("reject").isNull())
    return data.select(FEED, "row_num", *[
        (F.get("vals", F.lit(names.index(c))) if c in names else F.lit(None).cast("string")).alias(c) for c in columns])


def table_rows(rows: DataFrame, table: str) -> DataFrame:
    """SRC-04 + PRJ-09: one GTFS table as text columns in canonical order."""
    return _cells(rows, table, schemas.GTFS[table].names)


def raw_table_rows(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Validator view: the named columns, cells untrimmed (SRC-14)."""
    return _cells(rows, table, columns)


def headers(rows: DataFrame) -> DataFrame:
    """(feed_id, table_name, column) of every member header."""
    h = rows.where(F.col("row_num") == -1)
    return h.select(FEED, "table_name", F.explode("keys").alias("column"))


def preview(rows: DataFrame) -> DataFrame:
    """SRC-06: per feed — recognised tables with row counts, unknown members,
    missing required tables, rejects and the validity flag."""
    data = rows.where(F.col("reject").isNull())
    counts = data.where(F.col("table_name").isNotNull()).groupBy(FEED, "table_name").agg(
        F.count_if(F.col("row_num") >= 0).alias("rows"))
    per_feed = counts.groupBy(FEED).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "rows")))).alias("tables"))
    unknown = data.where(F.col("table_name").isNull() & F.col("member").isNotNull()).groupBy(FEED).agg(
        F.array_sort(F.collect_set("member")).alias("unknown_files"))
    rej = rows.where(F.col("reject").isNotNull()).groupBy(FEED).agg(F.collect_list("reject").alias("rejects"))
    feeds = rows.select(FEED).distinct()
    out = feeds.join(per_feed, FEED, "left").join(unknown, FEED, "left").join(rej, FEED, "left")
    have = F.coalesce(F.map_keys("tables"), F.array().cast("array<string>"))
    missing = F.array_compact(F.array(
        *[F.when(~F.array_contains(have, t), F.lit(f"{t}.txt")) for t in catalog.REQUIRED_TABLES],
        F.when(~(F.array_contains(have, "calendar") | F.array_contains(have, "calendar_dates")),
               F.lit("calendar.txt or calendar_dates.txt"))))
    return out.select(FEED, F.coalesce("tables", F.create_map().cast("map<string,bigint>")).alias("tables"),
                      F.coalesce("unknown_files", F.array().cast("array<string>")).alias("unknown_files"),
                      missing.alias("missing_required"),
                      F.coalesce("rejects", F.array().cast("array<string>")).alias("rejects"),
                      ((F.size(missing) == 0) & F.col("rejects").isNull()).alias("is_valid"))


def feed_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Every GTFS table of the archives as text columns (SRC-13 / store load input)."""
    return {t: table_rows(rows, t) for t in catalog.TABLES}


def validator_tables(rows: DataFrame, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Raw text tables keyed by file name for ``operators.validate`` (SRC-14)."""
    return {f"{t}.txt": raw_table_rows(rows, t, cols) for t, cols in columns.items()}
