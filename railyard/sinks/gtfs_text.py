"""GTFS text feed sink and exports (SNK-09/10/11/13, PRJ-13, PRJ-15, AG-25).

Each (feed, table) becomes one ``.txt`` member: UTF-8, CRLF line ends,
minimal quoting, NULL as empty, whole floats as integers, columns that are
NULL in every row of that feed left out, empty tables left out. Lines are
formatted as text columns in Spark (per-feed column choice comes from one
aggregate, one row per feed), then range-partitioned in member order — stored
order where rows carry ``row_order``, else by typed primary key — and written by ``feed_id``/``table``: a large member is several parts in the order
of their names, the header in the first; ``tabular.read_csv_text(parts=True)``
reads such a folder as one file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard import catalog, schemas
from railyard.functions import scalars as S
from railyard.operators import ordered, quality, service, store

FEED = "feed_id"


def _quote(cell: Column) -> Column:
    """Minimal quoting: only cells holding a comma, quote or line break."""
    needs = cell.rlike('[,"\\r\\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def _sortable(c: Column, kind: T.DataType) -> Column:
    """Text that sorts like the typed value (NULL first)."""
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(kind, T.IntegralType):
        shifted = c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
        return F.coalesce(F.lpad(shifted.cast("string"), 20, "0"), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def _member_order(df: DataFrame, table: str, cols: Sequence[str]) -> Column:
    """The sort key of a table's rows: stored order, else the primary key by its schema's types."""
    if store.ROW_ORDER in df.columns:
        return _sortable(F.col(store.ROW_ORDER), T.LongType())
    types = {f.name: f.dataType for f in schemas.GTFS[table].struct()}
    keys = [c for c in catalog.PRIMARY_KEYS.get(table, []) if c in cols] or cols[:1]
    parts = []
    for c in keys:
        given, kind = df.schema[c].dataType, types[c]
        if isinstance(given, T.IntegralType) or not isinstance(kind, T.IntegralType):
            parts.append(_sortable(F.col(c), given))
        else:  # numbers held as text: the number first, then the text of what is none
            parts += [_sortable(F.col(c).try_cast("long"), T.LongType()), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return F.concat_ws("\u0001", *parts)


def table_lines(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(feed_id, table, section, sort_key, line) rows of one GTFS table."""
    cols = [c for c in (columns or schemas.GTFS[table].names) if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "feed_id string, table string, section int, sort_key string, line string")
    floats = {c for c in cols if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))}
    cells = {c: S.format_cell(F.col(c), c in floats) for c in cols}
    # per feed: which columns hold at least one value (one row per feed)
    active = df.groupBy(FEED).agg(*[F.count(F.col(c)).alias(c) for c in cols]).select(
        FEED, F.array(*[F.when(F.col(c) > 0, F.lit(i)) for i, c in enumerate(cols)]).alias("_keep"))
    active = active.select(FEED, F.array_compact("_keep").alias("_keep"))
    names = F.array(*[F.lit(c) for c in cols])
    header = active.select(FEED, F.lit(table).alias("table"), F.lit(0).alias("section"), F.lit("").alias("sort_key"),
                           F.array_join(F.transform("_keep", lambda i: F.element_at(names, i + 1)), ",").alias("line"))
    body = df.join(active, FEED, "inner")
    vals = F.array(*[_quote(cells[c]) for c in cols])
    data = body.select(FEED, F.lit(table).alias("table"), F.lit(1).alias("section"), _member_order(df, table, cols).alias("sort_key"),
                       F.array_join(F.transform("_keep", lambda i: F.element_at(vals, i + 1)), ",").alias("line"))
    return header.unionByName(data)


MEMBER = [FEED, "table", "section", "sort_key", "line"]


def numbered_lines(df: DataFrame, table: str) -> DataFrame:
    """(feed_id, table, line_no, line): the lines of a member in file order, numbered from 1 (the header) by range."""
    numbered = ordered.dense_ordinal(table_lines(df, table), [FEED, "table"], MEMBER[2:], "line_no")
    return numbered.select(FEED, "table", "line_no", "line")


def write_feed(tables: Mapping[str, DataFrame], path: str, order: Sequence[str] = catalog.EXPORT_ORDER) -> None:
    """SNK-09: write every table of every feed as ``feed_id=/table=`` text."""
    lines = None
    for t in order:
        if t in tables:
            part = table_lines(tables[t], t)
            lines = part if lines is None else lines.unionByName(part)
    (lines.repartitionByRange(*MEMBER).sortWithinPartitions(*MEMBER)
     .select(FEED, "table", "line").write.mode("overwrite").option("lineSep", "\r\n")
     .partitionBy(FEED, "table").text(path))


def pre_export_issues(counts: DataFrame) -> DataFrame:
    """PRJ-15: per feed — required tables empty (error), no calendar (error),
    feed_info / shapes empty (warning)."""
    c = counts.groupBy(FEED).pivot("table_name", catalog.TABLES).agg(F.first("records"))
    frames = []
    for t in catalog.REQUIRED_TABLES:
        frames.append(c.where(F.coalesce(F.col(t), F.lit(0)) == 0).select(
            FEED, F.lit("error").alias("severity"), F.lit(f"Required table '{t}' is empty").alias("message")))
    no_cal = (F.coalesce(F.col("calendar"), F.lit(0)) == 0) & (F.coalesce(F.col("calendar_dates"), F.lit(0)) == 0)
    frames.append(c.where(no_cal).select(FEED, F.lit("error").alias("severity"),
                                         F.lit("Either calendar or calendar_dates must have data").alias("message")))
    for t in catalog.RECOMMENDED_TABLES:
        frames.append(c.where(F.coalesce(F.col(t), F.lit(0)) == 0).select(
            FEED, F.lit("warning").alias("severity"), F.lit(f"Recommended table '{t}' is empty").alias("message")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def export_feed(tables: Mapping[str, DataFrame], path: str, include_ride: bool = False):
    """SNK-10: gate, then all tables in canonical order for the feeds that
    pass; returns (issues, completeness, summary)."""
    counts = store.table_counts(tables)
    issues = pre_export_issues(counts)
    blocked = issues.where(F.col("severity") == "error").select(FEED).distinct()
    names = [t for t in catalog.EXPORT_ORDER if include_ride or t not in catalog.RIDE_TABLES]
    ok = {t: tables[t].join(blocked, FEED, "left_anti") for t in names if t in tables}
    write_feed(ok, path, names)
    summary = counts.where(F.col("table_name").isin(*names) & (F.col("records") > 0)).join(blocked, FEED, "left_anti") \
        .groupBy(FEED).agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"))
    return issues, quality.completeness(counts), summary


def export_subset(tables: Mapping[str, DataFrame], path: str, route_ids: DataFrame | None = None,
                  dates: DataFrame | None = None):
    """SNK-11: restrict to routes, then dates (JN-12, JN-13), then write; a
    feed left without trips gets an error row instead of files."""
    sub = dict(tables)
    if route_ids is not None:
        sub = {**sub, **service.restrict_to_routes(sub, route_ids)}
    if dates is not None:
        sub = {**sub, **service.restrict_to_dates(sub, dates)}
    feeds = tables["trips"].select(FEED).distinct()
    empty = feeds.join(sub["trips"].select(FEED).distinct(), FEED, "left_anti").select(
        FEED, F.lit("error").alias("severity"), F.lit("No trips remain after restriction").alias("message"))
    names = [t for t in catalog.EXPORT_ORDER if t in sub and t not in catalog.RIDE_TABLES]
    write_feed({t: sub[t] for t in names}, path, names)
    return empty


def write_page_csv(df: DataFrame, order: Sequence[str], limit: int, offset: int, path: str) -> None:
    """SNK-13: one page of a table as CSV."""
    store.page(df, order, limit, offset).drop(store.ROW_ORDER).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
