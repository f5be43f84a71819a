"""Store operations: upsert, NULL-key upsert, FK-enforced load, delete, gates, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard import catalog
from railyard.operators import joins, ordered, store
from railyard.plans import adapters as A
from railyard.plans.registry import register

# --- upsert ------------------------------------------------------------------------

_ORDER_VIEWS = {
    "old_orders": """
        SELECT 'F1' AS feed_id, o_orderkey AS trip_id, o_custkey AS route_id, o_orderstatus AS status,
               o_totalprice AS price, 'v0' AS version
        FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'""",
    "new_orders": """
        SELECT 'F1' AS feed_id, o_orderkey AS trip_id, o_custkey AS route_id, 'U' AS status,
               o_totalprice + 1 AS price, 'v1' AS version, 1 AS batch_seq
        FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'
        UNION ALL
        SELECT 'F1', o_orderkey, o_custkey, 'U', o_totalprice + 2, 'v2', 2
        FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
}


def _old_orders(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select(
        F.lit(A.FEED_ID).alias("feed_id"), F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit("v0").alias("version"))


def _new_orders(spark, sf):
    o = A.table(spark, sf, "orders")

    def batch(since, bump, version, seq):
        return o.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz")).select(
            F.lit(A.FEED_ID).alias("feed_id"), F.col("o_orderkey").alias("trip_id"),
            F.col("o_custkey").alias("route_id"), F.lit("U").alias("status"),
            (F.col("o_totalprice") + bump).alias("price"), F.lit(version).alias("version"),
            F.lit(seq).alias("batch_seq"))

    return batch("1996-01-01", 1, "v1", 1).unionByName(batch("1998-01-01", 2, "v2", 2))


@register(
    "upsert_orders",
    sql="""
    WITH latest AS (SELECT * FROM new_orders
                    QUALIFY row_number() OVER (PARTITION BY feed_id, trip_id ORDER BY batch_seq DESC, trip_id DESC) = 1)
    SELECT feed_id, trip_id, route_id, status, round(price, 2) AS price, version FROM old_orders o
    WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.feed_id = o.feed_id AND l.trip_id = o.trip_id)
    UNION ALL
    SELECT feed_id, trip_id, route_id, status, round(price, 2), version FROM latest
    """,
    extra_views=_ORDER_VIEWS,
)
def upsert_orders(spark, sf):
    out = joins.upsert(_old_orders(spark, sf), _new_orders(spark, sf), ["trip_id"], ["batch_seq", "trip_id"])
    return out.select("feed_id", "trip_id", "route_id", "status", F.round("price", 2).alias("price"), "version")


_NULL_KEY_VIEWS = {
    "old_keyed": """
        SELECT 'F1' AS feed_id, o_orderkey AS trip_id,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS service_date,
               o_orderstatus AS status, 'v0' AS version
        FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'""",
    "new_keyed": """
        SELECT 'F1' AS feed_id, o_orderkey AS trip_id,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS service_date,
               'U' AS status, 'v1' AS version, o_orderkey AS row_num
        FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'""",
}


def _keyed(spark, sf, new: bool):
    o = A.table(spark, sf, "orders")
    cond = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) if new else (
        F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    cols = [F.lit(A.FEED_ID).alias("feed_id"), F.col("o_orderkey").alias("trip_id"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_custkey")).alias("service_date"),
            (F.lit("U") if new else F.col("o_orderstatus")).alias("status"), F.lit("v1" if new else "v0").alias("version")]
    if new:
        cols.append(F.col("o_orderkey").alias("row_num"))
    return o.where(cond).select(*cols)


@register(
    "upsert_null_keys",
    sql="""
    WITH latest AS (SELECT * FROM new_keyed WHERE service_date IS NOT NULL
                    QUALIFY row_number() OVER (PARTITION BY feed_id, trip_id, service_date ORDER BY row_num DESC) = 1)
    SELECT feed_id, trip_id, service_date, status, version FROM old_keyed o
    WHERE service_date IS NULL OR NOT EXISTS (SELECT 1 FROM latest l WHERE l.feed_id = o.feed_id
                                             AND l.trip_id = o.trip_id AND l.service_date = o.service_date)
    UNION ALL SELECT feed_id, trip_id, service_date, status, version FROM latest
    UNION ALL SELECT feed_id, trip_id, service_date, status, version FROM new_keyed WHERE service_date IS NULL
    """,
    extra_views=_NULL_KEY_VIEWS,
)
def upsert_null_keys(spark, sf):
    """trip_capacity-style PK (trip_id, service_date) where service_date may be NULL:
    NULL keys never conflict, so such rows append on every load."""
    out = joins.upsert(_keyed(spark, sf, False), _keyed(spark, sf, True), ["trip_id", "service_date"], ["row_num"],
                       null_keys="distinct")
    return out.select("feed_id", "trip_id", "service_date", "status", "version")


# --- FK-enforced load (JN-09 + AG-21) ----------------------------------------------------

_LOAD_VIEWS = {
    "load_routes": """
        SELECT r.* REPLACE (CASE WHEN c_acctbal >= 0 THEN route_id ELSE -route_id END AS route_id)
        FROM a_routes r JOIN customer ON c_custkey = r.route_id""",
    "load_trips": """
        SELECT t.*, route_id IS NULL OR EXISTS (SELECT 1 FROM load_routes r WHERE r.route_id = t.route_id) AS ok
        FROM a_trips t""",
    "load_stop_times": """
        SELECT s.*, EXISTS (SELECT 1 FROM load_trips t WHERE t.ok AND t.trip_id = s.trip_id) AS ok_trip,
               s.stop_id IS NULL OR EXISTS (SELECT 1 FROM a_stops p WHERE p.stop_id = s.stop_id) AS ok_stop
        FROM a_stop_times s""",
}


def _enforced(spark, sf):
    """Routes of customers in debt carry another key, so their trips are refused, and
    the stop_times of refused trips are refused in turn (parents first)."""
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("route_id"), "c_acctbal")
    routes = A.a_routes(spark, sf).join(c, "route_id").withColumn(
        "route_id", F.when(F.col("c_acctbal") >= 0, F.col("route_id")).otherwise(-F.col("route_id"))).drop("c_acctbal")
    new = {
        "agency": A.a_agency(spark, sf),
        "routes": routes,
        "stops": A.a_stops(spark, sf),
        "trips": A.a_trips(spark, sf),
        "stop_times": A.a_stop_times(spark, sf),
    }
    return joins.fk_enforced_load(new, catalog.FK_EDGES, catalog.INSERT_ORDER)


@register(
    "fk_enforced_load",
    sql="""
    SELECT 'F1' AS feed_id, 'routes' AS table_name, (SELECT count(*) FROM load_routes) AS inserted, CAST(0 AS BIGINT) AS failed
    UNION ALL SELECT 'F1', 'trips', (SELECT count(*) FROM load_trips WHERE ok), (SELECT count(*) FROM load_trips WHERE NOT ok)
    UNION ALL SELECT 'F1', 'stop_times', (SELECT count(*) FROM load_stop_times WHERE ok_trip AND ok_stop),
                     (SELECT count(*) FROM load_stop_times WHERE NOT (ok_trip AND ok_stop))
    UNION ALL SELECT 'F1', 'stops', (SELECT count(*) FROM a_stops), 0
    UNION ALL SELECT 'F1', 'agency', (SELECT count(*) FROM a_agency), 0
    """,
    extra_views=_LOAD_VIEWS,
)
def fk_enforced_load(spark, sf):
    """Inserted and failed rows per table."""
    return joins.load_counts(*_enforced(spark, sf))


@register(
    "fk_enforced_rows",
    sql="""
    SELECT feed_id, 'trips' AS table_name, trip_id, CAST(NULL AS INTEGER) AS stop_sequence,
           CASE WHEN NOT ok THEN 'FOREIGN KEY constraint failed: route_id' END AS error
    FROM load_trips
    UNION ALL
    SELECT feed_id, 'stop_times', trip_id, stop_sequence,
           CASE WHEN NOT ok_trip THEN 'FOREIGN KEY constraint failed: trip_id'
                WHEN NOT ok_stop THEN 'FOREIGN KEY constraint failed: stop_id' END
    FROM load_stop_times
    """,
    extra_views=_LOAD_VIEWS,
)
def fk_enforced_rows(spark, sf):
    """Every trip and stop_time with its outcome: NULL for accepted rows, else the reason."""
    accepted, rejected = _enforced(spark, sf)
    frames = []
    for name, seq in (("trips", F.lit(None).cast("int")), ("stop_times", F.col("stop_sequence"))):
        for df, error in ((accepted[name], F.lit(None).cast("string")), (rejected[name], F.col("error"))):
            frames.append(df.select("feed_id", F.lit(name).alias("table_name"), "trip_id", seq.alias("stop_sequence"),
                                    error.alias("error")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- delete by composite key text (JN-11, SC-22) -----------------------------------------

@register(
    "delete_composite_keys",
    sql="""
    SELECT feed_id, trip_id, stop_sequence, stop_id FROM a_stop_times s
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R'
                      AND l.l_orderkey = s.trip_id AND l.l_linenumber = s.stop_sequence)
    """,
)
def delete_composite_keys(spark, sf):
    """Keys arrive as ``trip_id|stop_sequence`` text (the lines returned)."""
    li = A.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    keys_text = li.select(F.lit(A.FEED_ID).alias("feed_id"),
                          F.concat_ws("|", F.col("l_orderkey").cast("string"),
                                      F.col("l_linenumber").cast("string")).alias("key_text"))
    keys = joins.split_key_text(keys_text, "key_text", ["trip_id", "stop_sequence"],
                                {"trip_id": "bigint", "stop_sequence": "int"})
    st = A.a_stop_times(spark, sf).select("feed_id", "trip_id", "stop_sequence", "stop_id")
    remaining, _deleted = joins.delete_keys(st, keys, ["trip_id", "stop_sequence"])
    return remaining


# --- import-mode gate (SL-07) -------------------------------------------------------------

_GATE_VIEWS = {
    "archive_members": """
        SELECT CAST(o_custkey AS VARCHAR) AS feed_id,
               ['agency', 'stops', 'routes', 'trips', 'stop_times', 'calendar', 'calendar_dates', 'shapes']
                 [CAST(o_orderkey % 8 AS INTEGER) + 1] AS table_name
        FROM orders""",
    "feed_modes": """
        SELECT CAST(c_custkey AS VARCHAR) AS feed_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'replace' WHEN 'AUTOMOBILE' THEN 'merge'
                    WHEN 'MACHINERY' THEN 'merge_partial' WHEN 'HOUSEHOLD' THEN 'abort_if_not_empty'
                    ELSE 'merge_partial' END AS mode,
               c_acctbal > 0 AS store_populated
        FROM customer""",
}


@register(
    "import_mode_gate",
    sql="""
    WITH m AS (SELECT feed_id, count(*) AS n_members,
                      bool_or(table_name = 'agency') AS a, bool_or(table_name = 'stops') AS s,
                      bool_or(table_name = 'routes') AS r, bool_or(table_name = 'trips') AS t,
                      bool_or(table_name = 'stop_times') AS st,
                      bool_or(table_name IN ('calendar', 'calendar_dates')) AS c
               FROM archive_members GROUP BY feed_id),
         g AS (SELECT f.feed_id, f.mode, f.store_populated, coalesce(m.n_members, 0) AS n_members,
                      concat_ws(', ', CASE WHEN NOT coalesce(a, false) THEN 'agency' END,
                                      CASE WHEN NOT coalesce(s, false) THEN 'stops' END,
                                      CASE WHEN NOT coalesce(r, false) THEN 'routes' END,
                                      CASE WHEN NOT coalesce(t, false) THEN 'trips' END,
                                      CASE WHEN NOT coalesce(st, false) THEN 'stop_times' END,
                                      CASE WHEN NOT coalesce(c, false) THEN 'calendar_or_calendar_dates' END) AS missing
               FROM feed_modes f LEFT JOIN m ON m.feed_id = f.feed_id)
    SELECT feed_id, mode,
           CASE WHEN mode = 'merge_partial' AND n_members = 0 THEN 'Archive contains no recognised GTFS files to merge.'
                WHEN mode = 'merge_partial' AND NOT store_populated THEN
                  'MERGE_PARTIAL requires an already-populated database. Use REPLACE or MERGE for the initial load.'
                WHEN mode <> 'merge_partial' AND missing <> '' THEN 'Archive is missing required GTFS files: ' || missing
                WHEN mode = 'abort_if_not_empty' AND store_populated THEN
                  'Project database is not empty and mode=ABORT_IF_NOT_EMPTY'
           END AS reject_reason
    FROM g
    """,
    extra_views=_GATE_VIEWS,
)
def import_mode_gate(spark, sf):
    """Every customer is a project; its orders name the members of its archive."""
    o = A.table(spark, sf, "orders")
    names = F.array(*[F.lit(t) for t in ("agency", "stops", "routes", "trips", "stop_times", "calendar",
                                          "calendar_dates", "shapes")])
    members = o.select(F.col("o_custkey").cast("string").alias("feed_id"),
                       F.element_at(names, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("table_name"))
    c = A.table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    mode = (F.when(seg == "BUILDING", "replace").when(seg == "AUTOMOBILE", "merge")
            .when(seg == "MACHINERY", "merge_partial").when(seg == "HOUSEHOLD", "abort_if_not_empty")
            .otherwise("merge_partial"))
    feeds = c.select(F.col("c_custkey").cast("string").alias("feed_id"), mode.alias("mode"),
                     (F.col("c_acctbal") > 0).alias("store_populated"))
    return store.import_gate(feeds, members).select("feed_id", "mode", "reject_reason")


# --- paging (SL-01) -------------------------------------------------------------------------

@register(
    "page_of_table",
    sql="""
    SELECT 'F1' AS feed_id, stop_id, stop_name, zone_id FROM a_stops ORDER BY stop_id LIMIT 50 OFFSET 100
    """,
)
def page_of_table(spark, sf):
    """Page 3 (50 rows per page) of stops in key order: the limit is the feature."""
    return store.page(A.a_stops(spark, sf).select("feed_id", "stop_id", "stop_name", "zone_id"), ["stop_id"], 50, 100)


# --- row order (SNK-09, SL-01) -----------------------------------------------------------------

@register(
    "stored_row_order",
    sql=f"""
    WITH old AS (SELECT o_orderkey AS trip_id, o_orderdate AS day, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_order FROM orders),
         lines AS (SELECT l_orderkey AS trip_id, l_shipdate AS day, row_number() OVER (ORDER BY {", ".join(A.stop_time_order_cols())}) AS n FROM lineitem),
         top AS (SELECT coalesce(max(row_order), 0) AS n FROM old WHERE trip_id NOT IN (SELECT trip_id FROM lines)),
         last AS (SELECT trip_id, max_by(day, n) AS day, (SELECT n FROM top) + max(n) AS row_order FROM lines GROUP BY trip_id),
         merged AS (SELECT * FROM last UNION ALL SELECT * FROM old WHERE trip_id NOT IN (SELECT trip_id FROM last))
    SELECT 'F1' AS feed_id, trip_id, strftime(day, '%Y-%m-%d') AS day, row_order::BIGINT AS row_order FROM merged
    """,
)
def stored_row_order(spark, sf):
    """Row order of a merge: numbers go on from the rows that stay, and a replaced row takes its new place."""
    o = A.table(spark, sf, "orders").select(F.lit(A.FEED_ID).alias("feed_id"), F.col("o_orderkey").alias("trip_id"), F.col("o_orderdate").alias("day"))
    li = A.table(spark, sf, "lineitem").select(F.lit(A.FEED_ID).alias("feed_id"), F.col("l_orderkey").alias("trip_id"), F.col("l_shipdate").alias("day"),
                                               *A.stop_time_order_cols())
    stored = ordered.dense_ordinal(o, ["feed_id"], ["day", "trip_id"], store.ROW_ORDER)
    lines = ordered.dense_ordinal(li, ["feed_id"], A.stop_time_order_cols(), "row_num").select("feed_id", "trip_id", "day", "row_num")
    out = store.merge_rows(stored, lines, ["trip_id"])
    return out.select("feed_id", "trip_id", F.date_format("day", "yyyy-MM-dd").alias("day"), store.ROW_ORDER)


# --- clearing (SL-06) ---------------------------------------------------------------------------

@register(
    "cleared_tables",
    sql="""
    WITH t AS (SELECT o_orderstatus AS feed_id, 'trips' AS table_name FROM orders UNION ALL SELECT l_linestatus, 'stop_times' FROM lineitem)
    SELECT feed_id, table_name, count(*) AS records, feed_id = 'F' AS deleted FROM t GROUP BY feed_id, table_name
    """,
)
def cleared_tables(spark, sf):
    """SL-06: order and line states as feeds; the rows of feed F go, the others stay."""
    current = {"trips": A.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("feed_id")),
               "stop_times": A.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("feed_id"))}
    feeds = A.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderstatus").alias("feed_id")).distinct()
    keep, deleted = store.clear_tables(current, feeds)
    kept = None
    for t, df in keep.items():
        part = df.groupBy("feed_id").agg(F.count(F.lit(1)).alias("records")).select("feed_id", F.lit(t).alias("table_name"), "records", F.lit(False).alias("deleted"))
        kept = part if kept is None else kept.unionByName(part)
    return kept.unionByName(deleted.select("feed_id", "table_name", F.col("deleted").alias("records"), F.lit(True).alias("deleted")))
