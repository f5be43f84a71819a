"""Source / sink queries on data Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.functions import scalars as S
from railyard.operators import store
from railyard.plans import adapters as A
from railyard.plans.q_quality import _COUNTS_VIEW, feed_tables
from railyard.plans.registry import register
from railyard.sinks import gtfs_text
from railyard.sources import geojson, lineage


def part_features(spark, sf):
    """One GeoJSON FeatureCollection text per part row, geometry kind by key:
    every kind, valid and not (a ring that crosses itself; holes inside, outside
    and across their shell or touching it; members that touch or overlap)."""
    p = A.table(spark, sf, "part")
    k = F.col("p_partkey")
    lat = ((k * 7919 % 180) - 90).cast("double")
    lon = ((k * 104729 % 360) - 180).cast("double")
    at = lambda x, y: F.array(lon + x, lat + y)
    closed = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 0))
    bow_tie = F.array(at(0, 0), at(1, 1), at(1, 0), at(0, 1), at(0, 0))
    ring = lambda *corners: F.array(*[at(x, y) for x, y in (*corners, corners[0])])
    square = lambda a, b: ring((a, a), (b, a), (b, b), (a, b))
    shapes = [
        ("Point", at(0, 0)), ("LineString", F.array(at(0, 0), at(1, 1))), ("LineString", F.array(at(0, 0))),
        ("Polygon", F.array(closed)), ("Polygon", F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)))), None,
        ("Polygon", F.array(bow_tie)), ("MultiPoint", F.array(at(0, 0), at(1, 1))),
        ("MultiLineString", F.array(F.array(at(0, 0), at(1, 1)), F.array(at(2, 0), at(3, 1)))),
        ("MultiPolygon", F.array(F.array(closed))), ("MultiPolygon", F.array(F.array(closed), F.array(bow_tie))),
        ("Polygon", F.array(square(0, 4), ring((1, 1), (2, 1), (2, 2)))), ("Polygon", F.array(square(0, 4), ring((6, 6), (7, 6), (7, 7)))),
        ("Polygon", F.array(square(0, 4), ring((3, 3), (6, 3), (6, 6)))), ("MultiPolygon", F.array(F.array(closed), F.array(square(-1, 3)))),
        ("MultiPolygon", F.array(F.array(closed), F.array(ring((1, 1), (2, 1), (2, 2))))), ("Polygon", F.array(square(0, 4), ring((0, 0), (2, 1), (1, 2)))),
    ]
    kind = k % len(shapes)
    gtype, coords = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        if s is not None:
            gtype, coords = F.when(kind == i, F.lit(s[0])).otherwise(gtype), F.when(kind == i, F.to_json(s[1])).otherwise(coords)
    geometry = F.when(gtype.isNotNull(), F.struct(gtype.alias("type"), coords.alias("coordinates")))
    properties = F.map_filter(F.create_map(F.lit("stop_id"), k.cast("string"), F.lit("name"), F.col("p_name"),
                                           F.lit("brand"), F.when(F.col("p_size") > 25, F.col("p_brand"))), lambda _, v: v.isNotNull())
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    return geojson.features_from_json(p.select(doc.alias("doc")), "doc")


_GEOM_CASE = """CASE p_partkey % 17 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'LineString'
                WHEN 3 THEN 'Polygon' WHEN 4 THEN 'Polygon' WHEN 6 THEN 'Polygon' WHEN 7 THEN 'MultiPoint'
                WHEN 8 THEN 'MultiLineString' WHEN 9 THEN 'MultiPolygon' WHEN 10 THEN 'MultiPolygon' WHEN 11 THEN 'Polygon'
                WHEN 12 THEN 'Polygon' WHEN 13 THEN 'Polygon' WHEN 14 THEN 'MultiPolygon' WHEN 15 THEN 'MultiPolygon' WHEN 16 THEN 'Polygon' ELSE 'null' END"""
_GEOM_VALID = "p_partkey % 17 IN (0, 1, 3, 7, 8, 9, 11, 15, 16)"


@register(
    "geometry_filter",
    sql=f"""
    SELECT CAST(p_partkey AS VARCHAR) AS stop_id, {_GEOM_CASE} AS geometry_type, {_GEOM_VALID} AS is_valid
    FROM part
    """,
)
def geometry_filter(spark, sf):
    """SRC-10 + PRJ-11: parsed features with their validity."""
    f = part_features(spark, sf)
    return f.select(F.col("properties")["stop_id"].alias("stop_id"),
                    F.coalesce(F.col("geometry.type"), F.lit("null")).alias("geometry_type"),
                    geojson.geometry_valid(F.col("geometry")).alias("is_valid"))


@register("geometry_types", sql=f"SELECT {_GEOM_CASE} AS geometry_type, count(*) AS features FROM part GROUP BY 1")
def geometry_types(spark, sf):
    """AG-02: features per geometry type."""
    return geojson.geometry_metrics(part_features(spark, sf))


@register(
    "geometry_null_ratios",
    sql="""
    SELECT count(*) AS features, avg(CASE WHEN p_partkey % 17 = 5 THEN 1 ELSE 0 END) AS geometry, 0.0::DOUBLE AS stop_id,
           avg(CASE WHEN p_size > 25 THEN 0 ELSE 1 END) AS brand, 1.0::DOUBLE AS zone
    FROM part
    """,
)
def geometry_null_ratios(spark, sf):
    """AG-02: null ratios of the geometry and of properties, absent ones included."""
    return geojson.null_ratios(part_features(spark, sf), ["stop_id", "brand", "zone"])


def _sql_ring(*corners):
    return "'(' || " + " || ', ' || ".join(f"(lon + {x}) || ' ' || (lat + {y})" for x, y in (*corners, corners[0])) + " || ')'"


_SQUARE = _sql_ring((0, 0), (4, 0), (4, 4), (0, 4))
_SMALL = _sql_ring((1, 1), (2, 1), (2, 2))


@register(
    "geometry_wkt",
    sql=f"""
    WITH g AS (SELECT p_partkey, p_partkey % 17 AS k, CAST((p_partkey * 7919 % 180) - 90 AS DOUBLE) AS lat,
                      CAST((p_partkey * 104729 % 360) - 180 AS DOUBLE) AS lon FROM part),
         c AS (SELECT *, '(' || lon || ' ' || lat || ', ' || (lon + 1) || ' ' || lat || ', ' || (lon + 1) || ' ' || (lat + 1) || ', '
                          || lon || ' ' || lat || ')' AS ring, lon || ' ' || lat AS p0, (lon + 1) || ' ' || (lat + 1) AS p1 FROM g)
    SELECT CAST(p_partkey AS VARCHAR) AS stop_id,
           CASE k WHEN 0 THEN 'POINT (' || p0 || ')' WHEN 1 THEN 'LINESTRING (' || p0 || ', ' || p1 || ')' WHEN 3 THEN 'POLYGON (' || ring || ')'
                  WHEN 7 THEN 'MULTIPOINT (' || p0 || ', ' || p1 || ')'
                  WHEN 8 THEN 'MULTILINESTRING ((' || p0 || ', ' || p1 || '), (' || (lon + 2) || ' ' || lat || ', ' || (lon + 3) || ' ' || (lat + 1) || '))'
                  WHEN 9 THEN 'MULTIPOLYGON ((' || ring || '))' WHEN 11 THEN 'POLYGON (' || {_SQUARE} || ', ' || {_SMALL} || ')'
                  WHEN 15 THEN 'MULTIPOLYGON ((' || ring || '), (' || {_SMALL} || '))'
                  WHEN 16 THEN 'POLYGON (' || {_SQUARE} || ', ' || {_sql_ring((0, 0), (2, 1), (1, 2))} || ')' END AS wkt
    FROM c WHERE k IN (0, 1, 3, 7, 8, 9, 11, 15, 16)
    """,
)
def geometry_wkt(spark, sf):
    """SNK-03: the WKT text of every valid feature."""
    valid, _ = geojson.filter_valid(part_features(spark, sf))
    return valid.select(F.col("properties")["stop_id"].alias("stop_id"), geojson.to_wkt(F.col("geometry")).alias("wkt"))


@register(
    "geometry_validation",
    sql=f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE {_GEOM_VALID}) AS valid,
           count(*) FILTER (WHERE NOT ({_GEOM_VALID})) AS invalid, 'zone' AS missing_columns
    FROM part
    """,
)
def geometry_validation(spark, sf):
    """PRJ-12: total / valid / invalid and required properties never present."""
    v = geojson.validation_counts(part_features(spark, sf), ["stop_id", "name", "zone"])
    return v.select("total", "valid", "invalid", F.array_join("missing_columns", ",").alias("missing_columns"))


def _lineage_rows(spark, sf):
    o = A.table(spark, sf, "orders")
    run = F.col("o_orderkey").cast("string")
    silver = F.array(F.concat(F.lit("runs/"), run, F.lit("/silver/"), F.lower("o_orderstatus"), F.lit("_status.parquet")),
                     F.concat(F.lit("runs/"), run, F.lit("/silver/stops.parquet")))
    return o.select(F.col("o_orderpriority").alias("project"), run.alias("run_id"), F.col("o_orderdate").alias("created_at"),
                    F.array(F.concat(F.lit("runs/"), run, F.lit("/bronze/upload.csv"))).alias("bronze"),
                    silver.alias("silver"), F.array().cast("array<string>").alias("gold"))


@register(
    "latest_silver",
    sql="""
    WITH f AS (SELECT o_orderpriority AS project, CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS created_at,
                      unnest(['runs/' || CAST(o_orderkey AS VARCHAR) || '/silver/' || lower(o_orderstatus) || '_status.parquet',
                              'runs/' || CAST(o_orderkey AS VARCHAR) || '/silver/stops.parquet']) AS path
               FROM orders),
         d AS (SELECT *, regexp_extract(path, '([^/]+?)(?:\\.[A-Za-z0-9]+)?$', 1) AS dataset FROM f)
    SELECT project, dataset, path, strftime(created_at, '%Y-%m-%d') AS created_at FROM d
    QUALIFY row_number() OVER (PARTITION BY project, dataset ORDER BY created_at DESC, run_id DESC) = 1
    """,
)
def latest_silver(spark, sf):
    """SRC-15 / WN-05: newest Silver file per (project, dataset) from lineage rows."""
    out = lineage.latest_silver(_lineage_rows(spark, sf))
    return out.select("project", "dataset", "path", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


_STOP_COLS = ["stop_id", "stop_name", "stop_lat", "stop_lon", "zone_id", "location_type", "parent_station"]


def _num(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


@register(
    "gtfs_text_stops",
    sql=f"""
    SELECT 'F1' AS feed_id, 'stops' AS "table", 0 AS section, '{",".join(_STOP_COLS)}' AS line
    UNION ALL
    SELECT feed_id, 'stops', 1,
           CAST(stop_id AS VARCHAR) || ',' || coalesce(stop_name, '') || ',' || {_num('stop_lat')} || ',' ||
           {_num('stop_lon')} || ',' || coalesce(zone_id, '') || ',' || CAST(location_type AS VARCHAR) || ',' ||
           coalesce(CAST(parent_station AS VARCHAR), '')
    FROM a_stops
    """,
)
def gtfs_text_stops(spark, sf):
    """SNK-09: GTFS text lines of stops (header first; NULL as empty; whole floats as integers)."""
    stops = A.a_stops(spark, sf).select("feed_id", *_STOP_COLS)
    return gtfs_text.table_lines(stops, "stops").select("feed_id", "table", "section", "line")


def _long_trips(spark, sf):
    """lineitem as trips of many stops: the lines of a span of order keys are one trip."""
    li = A.table(spark, sf, "lineitem")
    return li.select(F.lit(A.FEED_ID).alias("feed_id"), (F.col("l_orderkey") - F.col("l_orderkey") % 32).alias("trip_id"),
                     ((F.col("l_orderkey") % 32) * 8 + F.col("l_linenumber")).alias("stop_sequence"), F.col("l_partkey").alias("stop_id"),
                     F.col("l_quantity").alias("shape_dist_traveled"))


@register(
    "gtfs_text_stop_times",
    sql=f"""
    WITH t AS (SELECT l_orderkey - l_orderkey % 32 AS trip_id, (l_orderkey % 32) * 8 + l_linenumber AS stop_sequence, l_partkey AS stop_id, l_quantity AS q FROM lineitem),
         l AS (SELECT trip_id, stop_sequence, trip_id || ',' || stop_id || ',' || stop_sequence || ',' || {_num('q')} AS line FROM t)
    SELECT 'F1' AS feed_id, 'stop_times' AS "table", 1::BIGINT AS line_no, 'trip_id,stop_id,stop_sequence,shape_dist_traveled' AS line
    UNION ALL
    SELECT 'F1', 'stop_times', 1 + row_number() OVER (ORDER BY trip_id, stop_sequence, line), line FROM l
    """,
)
def gtfs_text_stop_times(spark, sf):
    """SNK-09: the lines of stop_times in file order, sequence numbers in the order of numbers."""
    return gtfs_text.numbered_lines(_long_trips(spark, sf), "stop_times")


@register(
    "export_gate",
    sql="""
    SELECT feed_id, 'warning' AS severity, 'Recommended table ''' || table_name || ''' is empty' AS message
    FROM feed_counts WHERE table_name IN ('feed_info', 'shapes') AND records = 0
    UNION ALL
    SELECT feed_id, 'error', 'Required table ''' || table_name || ''' is empty'
    FROM feed_counts WHERE table_name IN ('agency', 'stops', 'routes', 'trips', 'stop_times') AND records = 0
    """,
    extra_views=_COUNTS_VIEW,
)
def export_gate(spark, sf):
    """PRJ-15: the pre-export gate over the feed's table counts."""
    return gtfs_text.pre_export_issues(store.table_counts(feed_tables(spark, sf)))


# --- lineage listings (SRC-16, SL-02/03, AG-23), direction labels (SC-20) --------------------

@register("list_runs", sql="SELECT o_orderpriority AS project, CAST(o_orderkey AS VARCHAR) AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders")
def list_runs(spark, sf):
    """SRC-16: the runs of every project."""
    return lineage.list_runs(_lineage_rows(spark, sf)).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


def _exports(spark, sf):
    """Every order is an export of its clerk's project, some of them subsets."""
    o = A.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 4 == 0, F.lit("_Subset")).otherwise(F.lit(""))
    return o.select(F.col("o_orderpriority").alias("project"), F.concat(F.lit("exports/feed"), F.col("o_orderkey").cast("string"), kind, F.lit(".zip")).alias("path"),
                    F.col("o_orderdate").alias("modified"))


_EXPORTS_VIEW = {"x": """
    SELECT o_orderpriority AS project, 'exports/feed' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '_Subset' ELSE '' END || '.zip' AS path, o_orderdate AS modified
    FROM orders"""}


@register(
    "list_exports",
    sql="SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY modified DESC, path DESC) AS rank FROM x",
    extra_views=_EXPORTS_VIEW,
)
def list_exports(spark, sf):
    """SL-02: exports of every project, newest first."""
    return lineage.list_exports(_exports(spark, sf)).select("project", "path", "rank")


@register(
    "latest_export",
    sql="""SELECT project, path FROM x WHERE path NOT LIKE '%_Subset%'
           QUALIFY row_number() OVER (PARTITION BY project ORDER BY modified DESC, path DESC) = 1""",
    extra_views=_EXPORTS_VIEW,
)
def latest_export(spark, sf):
    """SL-03: the newest full export of every project."""
    return lineage.latest_export(_exports(spark, sf))


@register(
    "maturity_levels",
    sql="""
    WITH bronze AS (SELECT DISTINCT c_custkey AS k FROM customer), silver AS (SELECT DISTINCT o_custkey AS k FROM orders),
         store AS (SELECT c_custkey AS k, count(o_orderkey) FILTER (WHERE o_totalprice > 100000) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
         done AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
    SELECT CAST(k AS VARCHAR) AS project,
           CASE WHEN k IN (SELECT k FROM done) THEN 4 WHEN k IN (SELECT k FROM store WHERE n > 0) THEN 3
                WHEN k IN (SELECT k FROM silver) THEN 2 WHEN k IN (SELECT k FROM bronze) THEN 1 ELSE 0 END AS maturity_level
    FROM (SELECT k FROM bronze UNION SELECT k FROM silver)
    """,
)
def maturity_levels(spark, sf):
    """AG-23: customers as projects: uploads, Silver orders, stored large orders, exports of closed ones."""
    c, o = A.table(spark, sf, "customer"), A.table(spark, sf, "orders")
    project = lambda df, key: df.select(F.col(key).cast("string").alias("project"))
    large = o.where(F.col("o_totalprice") > 100000).select("o_custkey", "o_orderkey")
    counts = c.join(large, c.c_custkey == large.o_custkey, "left").groupBy(F.col("c_custkey").cast("string").alias("feed_id")).agg(F.count("o_orderkey").alias("records"))
    return lineage.maturity(project(c, "c_custkey"), project(o, "o_custkey"), counts, project(o.where(F.col("o_orderstatus") == "P"), "o_custkey"))


@register(
    "direction_labels",
    sql="SELECT o_orderkey AS trip_id, CASE WHEN o_orderkey % 3 = 1 THEN 'inbound' ELSE 'outbound' END AS direction FROM orders",
)
def direction_labels(spark, sf):
    """SC-20: direction 0 or none is outbound, any other inbound."""
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("trip_id"), S.direction_label(F.when(k % 3 != 2, k % 3)).alias("direction"))
