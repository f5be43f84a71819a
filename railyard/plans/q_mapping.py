"""Silver → GTFS mapping queries over adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.operators import mapping as M
from railyard.plans import adapters as A
from railyard.plans.registry import register

ORDER = A.stop_time_order_cols()
_ORDER_SQL = ", ".join(ORDER)


def operations(spark, sf):
    """lineitem as Operations and Circulation rows: one line per supplier."""
    li = A.table(spark, sf, "lineitem")
    s = F.col("l_suppkey")
    return li.select(
        F.lit(A.FEED_ID).alias("feed_id"),
        F.concat(F.lit("L"), s.cast("string")).alias("line_id"),
        (F.col("l_orderkey") % 2).cast("int").alias("direction_id"),
        F.col("l_partkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"),
        F.format_string("%02d:%02d:00", 5 + s % 3, s * 7 % 60).alias("service_start_time"),
        (20 + s % 20).cast("string").alias("average_dwell_time"),
        F.concat(F.lit("Line "), s.cast("string")).alias("operating_lines"),
        *ORDER)


_OPS_VIEWS = {
    "ops": f"""
        SELECT 'F1' AS feed_id, 'L' || CAST(l_suppkey AS VARCHAR) AS line_id, CAST(l_orderkey % 2 AS INTEGER) AS direction_id,
               CAST(l_partkey AS VARCHAR) AS stop_id, l_linenumber AS stop_sequence,
               printf('%02d:%02d:00', 5 + l_suppkey % 3, l_suppkey * 7 % 60) AS service_start_time,
               20 + l_suppkey % 20 AS dwell, 'Line ' || CAST(l_suppkey AS VARCHAR) AS operating_lines, {_ORDER_SQL}
        FROM lineitem""",
    "gen_trips": f"""
        SELECT feed_id, line_id, direction_id,
               row_number() OVER (PARTITION BY feed_id ORDER BY {_ORDER_SQL}) AS idx
        FROM (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY feed_id, line_id, direction_id
                                                           ORDER BY {_ORDER_SQL}) = 1)""",
}


@register(
    "map_trips",
    sql="""
    SELECT feed_id, line_id AS route_id, 'WEEKDAY' AS service_id, printf('%s_%d_%04d', line_id, direction_id, idx) AS trip_id,
           direction_id
    FROM gen_trips
    """,
    extra_views=_OPS_VIEWS,
)
def map_trips(spark, sf):
    return M.map_trips(operations(spark, sf), ORDER)


@register(
    "map_stop_times",
    sql=f"""
    WITH r AS (SELECT *, row_number() OVER w AS k, first_value(service_start_time) OVER w AS st0,
                      first_value(dwell) OVER w AS dw0
               FROM ops WINDOW w AS (PARTITION BY feed_id, line_id, direction_id ORDER BY stop_sequence, {_ORDER_SQL})),
         a AS (SELECT r.*, printf('%s_%d_%04d', r.line_id, r.direction_id, g.idx) AS trip_id,
                      (CAST(split_part(st0, ':', 1) AS INTEGER) * 3600 + CAST(split_part(st0, ':', 2) AS INTEGER) * 60
                       + CAST(split_part(st0, ':', 3) AS INTEGER)) + (k - 1) * (dw0 + 120) AS arr
               FROM r JOIN gen_trips g USING (feed_id, line_id, direction_id))
    SELECT feed_id, trip_id,
           printf('%02d:%02d:%02d', arr // 3600, (arr % 3600) // 60, arr % 60) AS arrival_time,
           printf('%02d:%02d:%02d', (arr + dw0) // 3600, ((arr + dw0) % 3600) // 60, (arr + dw0) % 60) AS departure_time,
           stop_id, stop_sequence
    FROM a
    """,
    extra_views=_OPS_VIEWS,
)
def map_stop_times(spark, sf):
    ops = operations(spark, sf)
    return M.map_stop_times(ops, M.map_trips(ops, ORDER), ORDER)


@register(
    "map_routes",
    sql=f"""
    SELECT feed_id, line_id AS route_id, operating_lines AS route_short_name, 3 AS route_type
    FROM ops QUALIFY row_number() OVER (PARTITION BY feed_id, line_id ORDER BY {_ORDER_SQL}) = 1
    """,
    extra_views=_OPS_VIEWS,
)
def map_routes(spark, sf):
    return M.map_routes(operations(spark, sf), ORDER)


def connections(spark, sf):
    li = A.table(spark, sf, "lineitem")
    tt = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity").cast("int") - 10)
    return li.select(F.lit(A.FEED_ID).alias("feed_id"), F.col("l_partkey").alias("source_stop_id"),
                     (F.col("l_partkey") % 50).alias("target_stop_id"), tt.alias("travel_time_seconds"), *ORDER)


@register(
    "map_transfers",
    sql=f"""
    WITH c AS (SELECT 'F1' AS feed_id, CAST(l_partkey AS VARCHAR) AS from_stop_id, CAST(l_partkey % 50 AS VARCHAR) AS to_stop_id,
                      CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(trunc(l_quantity) AS INTEGER) - 10 END AS tt, {_ORDER_SQL}
               FROM lineitem
               QUALIFY row_number() OVER (PARTITION BY l_partkey, l_partkey % 50 ORDER BY {_ORDER_SQL}) = 1)
    SELECT feed_id, from_stop_id, to_stop_id, CASE WHEN tt > 0 THEN 2 ELSE 0 END AS transfer_type,
           CAST(tt AS BIGINT) AS min_transfer_time
    FROM c
    """,
)
def map_transfers(spark, sf):
    return M.map_transfers(connections(spark, sf), ORDER)


def calendar_events(spark, sf):
    e = A.table(spark, sf, "events")
    et = F.col("event_type")
    etype = (F.when(et == "signup", F.lit(" Holiday ")).when(et == "purchase", F.lit("special_event"))
             .when(et == "error", F.lit("STRIKE")).otherwise(et))
    eid = F.col("event_id")
    d = (F.when(eid % 50 == 0, F.lit("invalid"))
         .when(eid % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
         .when(eid % 3 == 1, F.date_format("ts", "dd/MM/yyyy"))
         .otherwise(F.date_format("ts", "yyyyMMdd")))
    return e.select(F.lit(A.FEED_ID).alias("feed_id"), etype.alias("event_type"), d.alias("event_date"))


@register(
    "map_calendar_dates",
    sql="""
    SELECT 'F1' AS feed_id, 'WEEKDAY' AS service_id, strftime(ts, '%Y%m%d') AS date,
           CASE WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS exception_type
    FROM events WHERE event_id % 50 <> 0
    """,
)
def map_calendar_dates(spark, sf):
    return M.map_calendar_dates(calendar_events(spark, sf))


def stop_features_all(spark, sf):
    p = A.table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    term = F.when(size % 7 == 0, F.lit(None)).otherwise(size % 2 == 0)
    return p.select(F.lit(A.FEED_ID).alias("feed_id"), k.cast("string").alias("stop_id"),
                    F.col("p_name").alias("stop_name"), ((k * 7919 % 180) - 90).cast("double").alias("latitude"),
                    ((k * 104729 % 360) - 180).cast("double").alias("longitude"), F.col("p_brand").alias("zone_id"),
                    term.alias("is_terminal"))


@register(
    "map_stops",
    sql="""
    SELECT 'F1' AS feed_id, CAST(p_partkey AS VARCHAR) AS stop_id, p_name AS stop_name,
           CAST((p_partkey * 7919 % 180) - 90 AS DOUBLE) AS stop_lat, CAST((p_partkey * 104729 % 360) - 180 AS DOUBLE) AS stop_lon,
           p_brand AS zone_id, CASE WHEN p_size % 7 <> 0 AND p_size % 2 = 0 THEN 1 ELSE 0 END AS location_type
    FROM part
    """,
)
def map_stops(spark, sf):
    return M.map_stops(stop_features_all(spark, sf))


@register(
    "map_agency",
    sql=r"""
    SELECT DISTINCT 'F1' AS feed_id,
           upper(regexp_replace(regexp_replace(regexp_replace(n_name, '^\s+|\s+$', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'),
                                '^_+|_+$', '', 'g')) AS agency_id,
           n_name AS agency_name, 'https://example.com' AS agency_url, 'America/Sao_Paulo' AS agency_timezone
    FROM supplier JOIN nation ON n_nationkey = s_nationkey
    """,
)
def map_agency(spark, sf):
    """Fleet rows (one per supplier) owned by their nation's operator."""
    s = A.table(spark, sf, "supplier").join(A.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    fleet = s.select(F.lit(A.FEED_ID).alias("feed_id"), F.col("n_name").alias("owner_operator"))
    return M.map_agency(fleet)


def fleet(spark, sf):
    s = A.table(spark, sf, "supplier")
    return s.select(F.lit(A.FEED_ID).alias("feed_id"), "s_suppkey", (F.col("s_nationkey") + 20).alias("seated_capacity"),
                    (F.col("s_nationkey") * 2 + 30).alias("total_capacity"), F.col("s_name").alias("manufacturer_model"))


@register(
    "map_trip_capacity",
    sql="""
    WITH f AS (SELECT CAST(trunc(avg(s_nationkey + 20)) AS BIGINT) AS seated, CAST(trunc(avg(s_nationkey * 2 + 30)) AS BIGINT) AS total,
                      arg_min(s_name, s_suppkey) AS model FROM supplier)
    SELECT t.feed_id, t.trip_id, CAST(NULL AS VARCHAR) AS service_date, f.model AS vehicle_description,
           f.seated AS seated_capacity, CASE WHEN f.total <> 0 AND f.seated <> 0 THEN f.total - f.seated END AS standing_capacity
    FROM a_trips t, f
    """,
)
def map_trip_capacity(spark, sf):
    return M.map_trip_capacity(fleet(spark, sf), A.a_trips(spark, sf), ["s_suppkey"])


def _ba_trips(spark, sf):
    """Trip lookup: one trip per (event type, user parity); events of 200 and more
    belong to an express line that no passenger row names."""
    e = A.table(spark, sf, "events")
    line = F.when(F.col("value") >= 200, F.concat(F.col("event_type"), F.lit("-express"))).otherwise(F.col("event_type"))
    ops = e.select(F.lit(A.FEED_ID).alias("feed_id"), line.alias("line_id"),
                   (F.col("user_id") % 2).cast("int").alias("direction_id"), "event_id")
    return M.map_trips(ops, ["event_id"])


@register(
    "map_board_alight",
    sql="""
    WITH g AS (SELECT feed_id, line_id, direction_id, row_number() OVER (PARTITION BY feed_id ORDER BY first_id) AS idx
               FROM (SELECT 'F1' AS feed_id, CASE WHEN value >= 200 THEN event_type || '-express' ELSE event_type END AS line_id,
                            CAST(user_id % 2 AS INTEGER) AS direction_id, min(event_id) AS first_id
                     FROM events GROUP BY 1, 2, 3)),
         t AS (SELECT feed_id, line_id, direction_id, idx, printf('%s_%d_%04d', line_id, direction_id, idx) AS trip_id FROM g),
         f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY feed_id, line_id ORDER BY idx) = 1),
         p AS (SELECT 'F1' AS feed_id, event_type AS line_id, CAST(event_id % 3 AS INTEGER) AS direction_id,
                      user_id, ts FROM events)
    SELECT p.feed_id, coalesce(t.trip_id, f.trip_id) AS trip_id, CAST(p.user_id AS VARCHAR) AS stop_id, 0 AS stop_sequence,
           0 AS record_use, CAST(p.user_id % 7 AS BIGINT) AS boardings, CAST(p.user_id % 5 AS BIGINT) AS alightings,
           p.user_id AS current_load, strftime(p.ts, '%Y%m%d') AS service_date
    FROM p LEFT JOIN t ON t.feed_id = p.feed_id AND t.line_id = p.line_id AND t.direction_id = p.direction_id
           LEFT JOIN f ON f.feed_id = p.feed_id AND f.line_id = p.line_id
    WHERE coalesce(t.trip_id, f.trip_id) IS NOT NULL
    """,
)
def map_board_alight(spark, sf):
    e = A.table(spark, sf, "events")
    passengers = e.select(F.lit(A.FEED_ID).alias("feed_id"), F.col("event_type").alias("line_id"),
                          (F.col("event_id") % 3).alias("direction_id"), F.col("user_id").alias("stop_id"),
                          F.col("ts").alias("timestamp"), (F.col("user_id") % 7).alias("boarding_count"),
                          (F.col("user_id") % 5).alias("alighting_count"), F.col("user_id").alias("number_of_users"))
    return M.map_board_alight(passengers, _ba_trips(spark, sf))


def _silver(spark, sf):
    """The Silver datasets of one feed, whole tables each."""
    from railyard.plans.q_features import stop_connections, stop_features

    e = A.table(spark, sf, "events")
    passengers = e.select(F.lit(A.FEED_ID).alias("feed_id"), F.concat(F.lit("L"), (F.col("user_id") % 20).cast("string")).alias("line_id"),
                          (F.col("event_id") % 2).alias("direction_id"), F.col("user_id").alias("stop_id"), F.col("ts").alias("timestamp"),
                          (F.col("user_id") % 7).alias("boarding_count"), (F.col("user_id") % 5).alias("alighting_count"),
                          F.col("user_id").alias("number_of_users"))
    return {"Stop Spatial Features": stop_features(spark, sf), "Operations and Circulation": operations(spark, sf),
            "Stop Connections": stop_connections(spark, sf), "Fleet Identification": fleet(spark, sf).join(
                A.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Operator "), F.col("s_nationkey").cast("string")).alias("owner_operator")), "s_suppkey"),
            "Transported Passengers": passengers}


@register(
    "map_feed_tables",
    sql="""
    WITH t AS (SELECT DISTINCT l_suppkey, l_orderkey % 2 AS d FROM lineitem)
    SELECT 'F1' AS feed_id, 'stops' AS table_name, (SELECT count(*) FROM part) AS records
    UNION ALL SELECT 'F1', 'routes', (SELECT count(DISTINCT l_suppkey) FROM lineitem)
    UNION ALL SELECT 'F1', 'trips', (SELECT count(*) FROM t)
    UNION ALL SELECT 'F1', 'stop_times', (SELECT count(*) FROM lineitem)
    UNION ALL SELECT 'F1', 'transfers', (SELECT count(DISTINCT o_custkey) FROM orders)
    UNION ALL SELECT 'F1', 'agency', (SELECT count(DISTINCT s_nationkey) FROM supplier)
    UNION ALL SELECT 'F1', 'trip_capacity', (SELECT count(*) FROM t)
    UNION ALL SELECT 'F1', 'board_alight', (SELECT count(*) FROM events WHERE user_id % 20 IN (SELECT l_suppkey FROM lineitem))
    """,
)
def map_feed_tables(spark, sf):
    """The whole Silver → GTFS run: rows per mapped table."""
    order = {"Operations and Circulation": ORDER, "Stop Connections": ["row_num"], "Fleet Identification": ["s_suppkey"]}
    tables = M.map_feed(_silver(spark, sf), order)
    out = None
    for name, df in tables.items():
        part = df.groupBy("feed_id").agg(F.count(F.lit(1)).alias("records")).select("feed_id", F.lit(name).alias("table_name"), "records")
        out = part if out is None else out.unionByName(part)
    return out
