"""Queries exercising the scalar function families SC-01..23 on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.functions import scalars as S
from railyard.plans import adapters as A
from railyard.plans.registry import register


@register(
    "normalize_names",
    sql=r"""
    SELECT p_partkey,
           replace(replace(replace(replace(replace(replace(replace(
               lower(regexp_replace(p_type, '^\s+|\s+$', '', 'g')),
               ' / ', '_'), '/', '_'), ' ', '_'), '-', '_'), '(', ''), ')', ''), '.', '') AS norm_type,
           regexp_replace(regexp_replace(lower(regexp_replace(p_name, '^\s+|\s+$', '', 'g')), '[^a-z0-9]+', '_', 'g'),
                          '^_+|_+$', '', 'g') AS safe_name,
           upper(regexp_replace(regexp_replace(regexp_replace(p_brand, '^\s+|\s+$', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'),
                                '^_+|_+$', '', 'g')) AS safe_id,
           upper(replace(regexp_replace(p_type, '^\s+|\s+$', '', 'g'), ' ', '_')) AS service_label
    FROM part
    """,
)
def normalize_names(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        S.normalize_column_name("p_type").alias("norm_type"),
        S.safe_name("p_name").alias("safe_name"),
        S.safe_id("p_brand").alias("safe_id"),
        S.service_id("p_type").alias("service_label"),
    )


@register(
    "normalize_sources",
    sql=r"""
    SELECT doc_id,
           replace(replace(replace(replace(replace(replace(replace(
               lower(regexp_replace(source, '^\s+|\s+$', '', 'g')),
               ' / ', '_'), '/', '_'), ' ', '_'), '-', '_'), '(', ''), ')', ''), '.', '') AS norm_source,
           regexp_replace(regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[^a-z0-9]+', '_', 'g'),
                          '^_+|_+$', '', 'g') AS safe_source,
           upper(regexp_replace(regexp_replace(regexp_replace(lang, '^\s+|\s+$', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'),
                                '^_+|_+$', '', 'g')) AS lang_id
    FROM documents
    """,
)
def normalize_sources(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        S.normalize_column_name("source").alias("norm_source"),
        S.safe_name("source").alias("safe_source"),
        S.safe_id("lang").alias("lang_id"),
    )


@register(
    "build_urns",
    sql=r"""
    SELECT o_orderkey,
           'PT:RY:ServiceJourney:' || regexp_replace(o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR),
                                                     '[^A-Za-z0-9_\-]', '_', 'g') AS journey_urn,
           printf('%s_%d_%04d',
                  upper(regexp_replace(regexp_replace(regexp_replace(o_orderpriority, '^\s+|\s+$', '', 'g'),
                                                      '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')),
                  CAST(o_orderkey % 2 AS INTEGER), CAST(o_custkey AS INTEGER)) AS generated_trip_id
    FROM orders
    """,
)
def build_urns(spark, sf):
    o = A.table(spark, sf, "orders")
    local = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    return o.select(
        "o_orderkey",
        S.build_urn("RY", "ServiceJourney", local).alias("journey_urn"),
        S.trip_id(S.safe_id("o_orderpriority"), F.col("o_orderkey") % 2, "o_custkey").alias("generated_trip_id"),
    )


@register(
    "date_texts",
    sql=r"""
    WITH t AS (
      SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_text, strftime(o_orderdate, '%d/%m/%Y') AS dmy_text,
             strftime(o_orderdate, '%Y%m') || lpad(CAST(day(o_orderdate) + 12 AS VARCHAR), 2, '0') AS shifted_text
      FROM orders)
    SELECT o_orderkey,
           replace(iso_text, '-', '') AS from_iso,
           substr(dmy_text, 7, 4) || substr(dmy_text, 4, 2) || substr(dmy_text, 1, 2) AS from_dmy,
           shifted_text,
           (regexp_full_match(shifted_text, '\d{8}') AND substr(shifted_text, 1, 4) <> '0000'
            AND try_strptime(shifted_text, '%Y%m%d') IS NOT NULL) AS shifted_valid,
           iso_text AS iso_back
    FROM t
    """,
)
def date_texts(spark, sf):
    o = A.table(spark, sf, "orders")
    t = o.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_text"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("dmy_text"),
        F.concat(F.date_format("o_orderdate", "yyyyMM"),
                 F.lpad((F.dayofmonth("o_orderdate") + 12).cast("string"), 2, "0")).alias("shifted_text"),
    )
    return t.select(
        "o_orderkey",
        S.to_yyyymmdd("iso_text").alias("from_iso"),
        S.to_yyyymmdd("dmy_text").alias("from_dmy"),
        "shifted_text",
        S.is_valid_yyyymmdd("shifted_text").alias("shifted_valid"),
        S.yyyymmdd_to_iso(S.to_yyyymmdd("iso_text")).alias("iso_back"),
    )


@register(
    "gtfs_times",
    sql=r"""
    WITH t AS (
      SELECT trip_id, stop_sequence, arrival_secs, l_quantity,
             printf('%02d:%02d:%02d', arrival_secs // 3600, (arrival_secs % 3600) // 60, arrival_secs % 60) AS arrival_time,
             CASE WHEN stop_sequence % 3 = 0 THEN printf('%d:%02d', stop_sequence, CAST(l_quantity AS INTEGER))
                  WHEN stop_sequence % 3 = 1 THEN CAST(l_quantity AS VARCHAR)
                  ELSE 'n/a' END AS dwell_text
      FROM a_stop_times)
    SELECT trip_id, stop_sequence, arrival_time,
           arrival_secs AS seconds_back,
           printf('%02d:%02d:%02d', (arrival_secs // 3600) % 24, (arrival_secs % 3600) // 60, arrival_secs % 60) AS netex_time,
           CAST(arrival_secs // 86400 AS INTEGER) AS day_offset,
           CAST(CASE WHEN stop_sequence % 3 = 0 THEN stop_sequence * 60 + CAST(l_quantity AS INTEGER)
                WHEN stop_sequence % 3 = 1 THEN CAST(trunc(l_quantity) AS BIGINT)
                ELSE 30 END AS BIGINT) AS dwell_secs
    FROM t
    """,
)
def gtfs_times(spark, sf):
    st = A.a_stop_times(spark, sf)
    seq = F.col("stop_sequence")
    dwell = (
        F.when(seq % 3 == 0, F.format_string("%d:%02d", seq, F.col("l_quantity").cast("int")))
        .when(seq % 3 == 1, F.col("l_quantity").cast("string"))
        .otherwise(F.lit("n/a"))
    )
    t = st.select("trip_id", "stop_sequence", S.seconds_to_time("arrival_secs").alias("arrival_time"),
                  dwell.alias("dwell_text"))
    parts = S.gtfs_time_parts("arrival_time")
    return t.select(
        "trip_id", "stop_sequence", "arrival_time",
        S.time_to_seconds("arrival_time").cast("long").alias("seconds_back"),
        parts["time"].alias("netex_time"),
        parts["day_offset"].alias("day_offset"),
        S.parse_duration_secs("dwell_text").alias("dwell_secs"),
    )


@register(
    "csv_cells",
    sql=r"""
    WITH t AS (SELECT p_partkey, p_retailprice, p_size, p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name AS long_text
               FROM part)
    SELECT p_partkey,
           CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR)
                ELSE CAST(p_retailprice AS VARCHAR) END AS price_text,
           rtrim(rtrim(CAST(CAST(CAST(p_size / 100000.0::DOUBLE AS VARCHAR) AS DECIMAL(38, 20)) AS VARCHAR), '0'), '.') AS small_text,
           rtrim(rtrim(CAST(CAST(CAST(-p_size * 1234567.0::DOUBLE - 0.5 AS VARCHAR) AS DECIMAL(38, 20)) AS VARCHAR), '0'), '.')
             AS huge_text,
           CAST(p_size AS VARCHAR) AS size_text,
           CASE WHEN length(long_text) > 40 THEN substr(long_text, 1, 37) || '…' ELSE long_text END AS sample_text
    FROM t
    """,
)
def csv_cells(spark, sf):
    p = A.table(spark, sf, "part")
    long_text = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name")
    return p.select(
        "p_partkey",
        S.format_cell("p_retailprice", is_float=True).alias("price_text"),
        S.format_cell(F.col("p_size") / F.lit(100000.0), is_float=True).alias("small_text"),
        S.format_cell(-F.col("p_size") * F.lit(1234567.0) - F.lit(0.5), is_float=True).alias("huge_text"),
        S.format_cell("p_size", is_float=False).alias("size_text"),
        S.stringify(long_text).alias("sample_text"),
    )


@register(
    "code_maps",
    sql="""
    SELECT p_partkey,
           CASE p_size % 6 WHEN 0 THEN 'Quay' WHEN 1 THEN 'StopPlace' WHEN 2 THEN 'StopPlaceEntrance' WHEN 3 THEN 'PathJunction'
                WHEN 4 THEN 'BoardingPosition' END AS element,
           CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'true' WHEN 2 THEN 'false' END AS limitation,
           CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS DOUBLE) END AS centroid_longitude,
           CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS centroid_latitude
    FROM part
    """,
)
def code_maps(spark, sf):
    """SC-17 maps (codes without an entry are NULL) and SC-20 centroids (NULL without both coordinates)."""
    p = A.table(spark, sf, "part")
    at = S.centroid(F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")), F.col("p_partkey").cast("double"))
    return p.select("p_partkey", S.stop_place_element(F.col("p_size") % 6).alias("element"),
                    S.wheelchair_limitation(F.col("p_size") % 4).alias("limitation"),
                    at["longitude"].alias("centroid_longitude"), at["latitude"].alias("centroid_latitude"))


@register(
    "netex_file_names",
    sql="""
    SELECT o_orderkey,
           'NETEX_PT_' || upper(regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '_', 'g')) || '_' || strftime(o_orderdate, '%Y%m%d') || '_'
             || strftime(o_orderdate, '%Y%m%d') || '0000' AS bundle,
           'TimetableFrame_Schedules_Line_' || regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '_', 'g') AS document
    FROM orders
    """,
)
def netex_file_names(spark, sf):
    """SC-23: bundle and timetable document names."""
    o = A.table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return o.select("o_orderkey", S.netex_bundle_name("o_orderpriority", day, F.col("o_orderdate").cast("timestamp_ntz")).alias("bundle"),
                    S.timetable_document_name("o_orderpriority").alias("document"))


@register(
    "durations",
    sql="""
    WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber
                 WHEN 1 THEN (l_orderkey % 90) || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0')
                 WHEN 2 THEN (l_orderkey % 30) || ':' || (l_partkey % 60) || ':' || (l_suppkey % 60)
                 WHEN 3 THEN ' ' || l_partkey || '.75 ' WHEN 4 THEN 'soon' WHEN 5 THEN '1:x' WHEN 6 THEN '' END AS text,
                 l_orderkey % 90 AS m, l_orderkey % 30 AS h, l_partkey AS p, l_suppkey AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, text, CASE l_linenumber WHEN 1 THEN m * 60 + p % 60 WHEN 2 THEN h * 3600 + (p % 60) * 60 + s % 60
                                                 WHEN 3 THEN p ELSE 30 END AS seconds
    FROM t
    """,
)
def durations(spark, sf):
    """SC-10: clock texts, numbers, and what is neither (the default)."""
    li = A.table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    o, p, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    value = (F.when(n == 1, F.concat((o % 90).cast("string"), F.lit(":"), F.lpad((p % 60).cast("string"), 2, "0")))
             .when(n == 2, F.concat_ws(":", *[x.cast("string") for x in (o % 30, p % 60, s % 60)]))
             .when(n == 3, F.concat(F.lit(" "), text("l_partkey"), F.lit(".75 "))).when(n == 4, "soon").when(n == 5, "1:x").when(n == 6, ""))
    return li.select("l_orderkey", "l_linenumber", value.alias("text"), S.parse_duration_secs(value).alias("seconds"))
