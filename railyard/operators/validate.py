"""Feed validator (VAL-01..09) and issue summary (AG-13) as DataFrames.

Input tables are raw text frames (every cell a string, as read from a feed
archive) with ``feed_id`` and a row index column. Every check returns issue
rows ``(feed_id, severity, file_name, field, row_index, message)`` plus any
``carry`` columns; the checks are unioned (SO-05) and only counted, never
collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard import catalog
from railyard.functions import scalars as S
from railyard.operators import ordered
from railyard.operators.joins import missing_references

FEED = "feed_id"
ISSUE_COLS = [FEED, "severity", "file_name", "field", "row_index", "message"]


def _issue(df: DataFrame, severity: str, file: str, field: str | None, row_col: str | None, message: Column,
           carry: Sequence[str] = ()) -> DataFrame:
    return df.select(
        FEED,
        F.lit(severity).alias("severity"),
        F.lit(file).alias("file_name"),
        F.lit(field).cast("string").alias("field"),
        (F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")).alias("row_index"),
        message.alias("message"),
        *carry,
    )


def union_issues(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# VAL-01 ---------------------------------------------------------------------------
def required_files(present: DataFrame) -> DataFrame:
    """``present``: (feed_id, file_name) of the members of each feed.

    One anti join per required file (a fixed list of five), no cross join."""
    feeds = present.select(FEED).distinct()
    frames = []
    for f in catalog.REQUIRED_FILES:
        miss = feeds.join(present.where(F.col("file_name") == f).select(FEED), FEED, "left_anti")
        frames.append(_issue(miss, "error", f, None, None, F.lit(f"Required file '{f}' missing from feed")))
    has_cal = present.where(F.col("file_name").isin(*catalog.CALENDAR_FILES)).select(FEED)
    no_cal = feeds.join(has_cal, FEED, "left_anti")
    frames.append(_issue(no_cal, "error", "calendar.txt", None, None,
                         F.lit("Either calendar.txt or calendar_dates.txt is required")))
    return union_issues(frames)


# VAL-02 ---------------------------------------------------------------------------
def required_fields(tables: Mapping[str, DataFrame], row_col: str = "row_num",
                    carry: Sequence[str] = ()) -> list[DataFrame]:
    """Header missing (error, plan-time per table), empty value per row (error).
    Members without data rows are reported by ``empty_file_warnings``."""
    out = []
    for fname, req in catalog.REQUIRED_FIELDS.items():
        df = tables.get(fname)
        if df is None:
            continue
        feeds = df.select(FEED).distinct()
        for fld in req:
            if fld not in df.columns:
                out.append(_issue(feeds, "error", fname, fld, None,
                                  F.lit(f"Required field '{fld}' missing from header")))
                continue
            empty = df.where(F.col(fld).isNull() | (S.strip(F.col(fld).cast("string")) == ""))
            out.append(_issue(empty, "error", fname, fld, row_col, F.lit(f"Required field '{fld}' is empty"),
                              carry))
    return out


def empty_file_warnings(archive_rows: DataFrame) -> DataFrame:
    """VAL-02 (warning): members of the validated files that have a header
    but no data rows, from the archive row stream (``sources.archive``)."""
    members = archive_rows.where(F.col("table_name").isNotNull() & F.col("reject").isNull())
    per = members.groupBy(FEED, "table_name").agg(F.count_if(F.col("row_num") >= 0).alias("_rows"))
    empty = per.where((F.col("_rows") == 0) & F.col("table_name").isin(
        *[f[:-4] for f in catalog.REQUIRED_FIELDS]))
    file_name = F.concat(F.col("table_name"), F.lit(".txt"))
    return empty.select(FEED, F.lit("warning").alias("severity"), file_name.alias("file_name"),
                        F.lit(None).cast("string").alias("field"), F.lit(None).cast("long").alias("row_index"),
                        F.format_string("File '%s' has no data rows", file_name).alias("message"))


# VAL-03 ---------------------------------------------------------------------------
def duplicate_primary_keys(tables: Mapping[str, DataFrame], row_col: str = "row_num") -> list[DataFrame]:
    out = []
    for fname, pk in catalog.VALIDATOR_PRIMARY_KEYS.items():
        df = tables.get(fname)
        if df is None or not all(c in df.columns for c in pk):
            continue
        nonempty = df
        for c in pk:
            nonempty = nonempty.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
        dups = ordered.duplicates_after_first(nonempty.select(FEED, *pk, row_col), [FEED, *pk], [row_col], "_first")
        vals = ", ".join(["'%s'"] * len(pk))
        msg = F.format_string(f"Duplicate primary key {pk}=[{vals}] (also at row %d)",
                              *[F.col(c).cast("string") for c in pk], F.col(f"_first.{row_col}"))
        out.append(_issue(dups, "error", fname, None, row_col, msg))
    return out


# VAL-04 ---------------------------------------------------------------------------
def references(tables: Mapping[str, DataFrame], row_col: str = "row_num") -> list[DataFrame]:
    out = []
    trips, routes = tables.get("trips.txt"), tables.get("routes.txt")
    cal, cal_d = tables.get("calendar.txt"), tables.get("calendar_dates.txt")
    stops, st = tables.get("stops.txt"), tables.get("stop_times.txt")
    spark = next(iter(tables.values())).sparkSession

    def keys(df, col):
        return (df, col) if df is not None else (spark.createDataFrame([], f"{FEED} string, {col} string"), col)

    if trips is not None:
        out.append(missing_references(trips, "route_id", [keys(routes, "route_id")], "trips.txt", row_col,
                                      "route_id '%s' not found in routes.txt"))
        out.append(missing_references(trips, "service_id", [keys(cal, "service_id"), keys(cal_d, "service_id")],
                                      "trips.txt", row_col, "service_id '%s' not found in calendar(_dates).txt"))
    if st is not None:
        out.append(missing_references(st, "trip_id", [keys(trips, "trip_id")], "stop_times.txt", row_col,
                                      "trip_id '%s' not found in trips.txt"))
        out.append(missing_references(st, "stop_id", [keys(stops, "stop_id")], "stop_times.txt", row_col,
                                      "stop_id '%s' not found in stops.txt"))
    return out


# VAL-05 ---------------------------------------------------------------------------
def time_format(stop_times: DataFrame, row_col: str = "row_num", carry: Sequence[str] = ()) -> list[DataFrame]:
    out = []
    for col in ("arrival_time", "departure_time"):
        if col not in stop_times.columns:
            continue
        v = F.col(col)
        bad = stop_times.where(v.isNotNull() & (v != "") & ~v.rlike(catalog.TIME_PATTERN))
        out.append(_issue(bad, "error", "stop_times.txt", col, row_col,
                          F.format_string(f"{col} '%s' does not match HH:MM:SS", v), carry))
    return out


# VAL-06 ---------------------------------------------------------------------------
def date_logic(calendar: DataFrame | None, calendar_dates: DataFrame | None, row_col: str = "row_num") -> list[DataFrame]:
    out = []
    if calendar is not None:
        for col in ("start_date", "end_date"):
            v = F.col(col)
            bad = calendar.where(v.isNotNull() & (v != "") & ~S.is_valid_yyyymmdd(v))
            out.append(_issue(bad, "error", "calendar.txt", col, row_col,
                              F.format_string(f"{col} '%s' is not a valid YYYYMMDD date", v)))
        s, e = F.col("start_date"), F.col("end_date")
        rev = calendar.where(s.rlike(catalog.DATE_PATTERN) & e.rlike(catalog.DATE_PATTERN) & (s > e))
        out.append(_issue(rev, "error", "calendar.txt", None, row_col,
                          F.format_string("start_date '%s' is after end_date '%s'", s, e)))
    if calendar_dates is not None:
        v = F.col("date")
        bad = calendar_dates.where(v.isNotNull() & (v != "") & ~S.is_valid_yyyymmdd(v))
        out.append(_issue(bad, "error", "calendar_dates.txt", "date", row_col,
                          F.format_string("date '%s' is not a valid YYYYMMDD date", v)))
    return out


# VAL-07 ---------------------------------------------------------------------------
def _py_float_text(d: Column) -> Column:
    """Python's str(float) for ordinary magnitudes: at least one decimal."""
    t = d.cast("string")
    return F.when(t.rlike(r"^-?\d+$"), F.concat(t, F.lit(".0"))).otherwise(t)


def coordinates(stops: DataFrame, row_col: str = "row_num") -> list[DataFrame]:
    out = []
    for col, lo, hi in (("stop_lat", -90, 90), ("stop_lon", -180, 180)):
        if col not in stops.columns:
            continue
        v = F.coalesce(F.col(col).cast("string"), F.lit(""))
        d = S.parse_number(v)
        nonnum = stops.where((v != "") & d.isNull())
        out.append(_issue(nonnum, "error", "stops.txt", col, row_col,
                          F.format_string(f"{col} '%s' is not numeric", v)))
        rng = stops.where((v != "") & d.isNotNull() & ~d.between(lo, hi))
        out.append(_issue(rng, "error", "stops.txt", col, row_col,
                          F.format_string(f"{col} %s is outside [{lo}, {hi}]", _py_float_text(d))))
    return out


# VAL-08 ---------------------------------------------------------------------------
def route_metadata(routes: DataFrame, row_col: str = "row_num") -> list[DataFrame]:
    out = []
    for col in ("route_color", "route_text_color"):
        if col not in routes.columns:
            continue
        v = F.coalesce(F.col(col), F.lit(""))
        bad = routes.where((v != "") & ~v.rlike(catalog.COLOR_PATTERN))
        out.append(_issue(bad, "warning", "routes.txt", col, row_col,
                          F.format_string(f"{col} '%s' is not a 6-digit hex string", v)))
    if "route_type" in routes.columns:
        v = F.coalesce(F.col("route_type").cast("string"), F.lit(""))
        isint = S.strip(v).rlike(r"^[+-]?\d+$")
        # as a decimal, so that no integer is too large to be reported
        i = F.when(isint, S.strip(v).try_cast("decimal(38,0)"))
        known = F.coalesce(i.isin(*catalog.VALID_ROUTE_TYPES), F.lit(False))
        nonint = routes.where((v != "") & ~isint)
        out.append(_issue(nonint, "error", "routes.txt", "route_type", row_col,
                          F.format_string("route_type '%s' is not an integer", v)))
        odd = routes.where((v != "") & isint & ~known)
        out.append(_issue(odd, "warning", "routes.txt", "route_type", row_col,
                          F.format_string("route_type %s is not a standard value", F.coalesce(i.cast("string"), S.strip(v)))))
    return out


# VAL-09 ---------------------------------------------------------------------------
def stop_sequence_order(stop_times: DataFrame, row_col: str = "row_num") -> list[DataFrame]:
    seq = S.strip(F.col("stop_sequence").cast("string"))
    st = stop_times.where(seq.rlike(r"^[+-]?\d+$")).withColumn("_seq", seq.cast("long"))
    lagged = ordered.lag_over(st, [FEED, "trip_id"], [row_col], "_seq", "_prev")
    bad = lagged.where(F.col("_prev").isNotNull() & (F.col("_seq") <= F.col("_prev")))
    msg = F.format_string("trip_id '%s' stop_sequence must strictly increase (saw %d then %d)",
                          F.col("trip_id"), F.col("_prev"), F.col("_seq"))
    return [_issue(bad, "error", "stop_times.txt", "stop_sequence", row_col, msg)]


# SO-05 + AG-13 --------------------------------------------------------------------
def validate_feed(tables: Mapping[str, DataFrame], row_col: str = "row_num") -> DataFrame:
    """All row-level checks of one or many feeds (VAL-02..09)."""
    frames = []
    frames += required_fields(tables, row_col)
    frames += duplicate_primary_keys(tables, row_col)
    frames += references(tables, row_col)
    if "stop_times.txt" in tables:
        frames += time_format(tables["stop_times.txt"], row_col)
        frames += stop_sequence_order(tables["stop_times.txt"], row_col)
    frames += date_logic(tables.get("calendar.txt"), tables.get("calendar_dates.txt"), row_col)
    if "stops.txt" in tables:
        frames += coordinates(tables["stops.txt"], row_col)
    if "routes.txt" in tables:
        frames += route_metadata(tables["routes.txt"], row_col)
    return union_issues([f.select(*ISSUE_COLS) for f in frames])


def issue_summary(issues: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """AG-13: counts per severity, validity and the quality tag per feed."""
    agg = issues.groupBy(FEED).agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(~F.col("severity").isin("error", "warning")).alias("info_count"),
    )
    if feeds is not None:
        agg = feeds.select(FEED).distinct().join(agg, FEED, "left").na.fill(0, ["error_count", "warning_count",
                                                                                 "info_count"])
    return agg.select(
        FEED, "error_count", "warning_count", "info_count",
        (F.col("error_count") == 0).alias("is_valid"),
        F.when(F.col("error_count") > 0, F.lit("draft"))
        .when(F.col("warning_count") > 0, F.lit("warnings"))
        .otherwise(F.lit("certified")).alias("quality_tag"),
    )


def validate_text_export(spark, path: str) -> DataFrame:
    """VAL-10: run the validator on a written text export
    (``<path>/feed_id=<f>/table=<t>/`` folders), raw cells, real line order.

    Each file is read by its own header, so feeds may leave out different
    columns. A table that no feed has is absent; any other read error rises."""
    from railyard.sources import tabular

    tables = {}
    for t in ("agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates"):
        glob = f"{path}/feed_id=*/table={t}"
        if not tabular.path_exists(spark, glob):
            continue
        df = tabular.read_csv_text(spark, glob, parts=True)
        tables[f"{t}.txt"] = df.withColumn(FEED, F.regexp_extract("_file", r"feed_id=([^/]+)", 1)).drop("_file")
    if not tables:
        raise FileNotFoundError(f"no exported table under {path}")
    present = None
    for name, df in tables.items():
        p = df.select(FEED).distinct().withColumn("file_name", F.lit(name))
        present = p if present is None else present.unionByName(p)
    return validate_feed(tables).unionByName(required_files(present))
