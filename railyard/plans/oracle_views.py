"""The adapter views written independently in SQL for the DuckDB oracle.

``with_views("SELECT … FROM a_trips …")`` prefixes the CTEs the statement
references. Keep these in step with ``adapters.py`` by meaning, not by code.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "a_agency": """
        SELECT 'F1' AS feed_id, n_nationkey AS agency_id, n_name AS agency_name FROM nation""",
    "a_routes": """
        SELECT 'F1' AS feed_id, c_custkey AS route_id, c_nationkey AS agency_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'AUTOMOBILE' THEN 11
                    WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 0 WHEN 'FURNITURE' THEN 9 END AS route_type,
               c_name AS route_short_name, c_mktsegment AS route_long_name
        FROM customer""",
    "a_trips": """
        SELECT 'F1' AS feed_id, o_orderkey AS trip_id, o_custkey AS route_id,
               o_orderkey % 110 AS service_id, CAST(o_orderkey % 2 AS INTEGER) AS direction_id,
               o_orderkey AS row_num, o_orderstatus AS trip_status
        FROM orders""",
    "a_stop_times": """
        SELECT 'F1' AS feed_id, l_orderkey AS trip_id, l_linenumber AS stop_sequence, l_partkey AS stop_id,
               (l_orderkey * 37 + l_linenumber * 600) % 100000 AS arrival_secs,
               (l_orderkey * 37 + l_linenumber * 600) % 100000 + 60 AS departure_secs,
               l_quantity AS shape_dist_traveled,
               l_shipdate, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax
        FROM lineitem""",
    "a_pattern_stop_times": """
        SELECT 'F1' AS feed_id, l_orderkey AS trip_id, l_linenumber AS stop_sequence, l_partkey % 3 AS stop_id,
               (l_orderkey * 37 + l_linenumber * 600) % 100000 AS arrival_secs,
               (l_orderkey * 37 + l_linenumber * 600) % 100000 + 60 AS departure_secs,
               l_shipdate, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax
        FROM lineitem""",
    "a_stops": """
        SELECT 'F1' AS feed_id, p_partkey AS stop_id, p_name AS stop_name, p_brand AS zone_id,
               p_size % 3 AS location_type,
               CASE WHEN p_size % 10 = 0 THEN -1 WHEN p_size % 2 = 0 THEN p_partkey + 1 END AS parent_station,
               CAST((p_partkey * 7919 % 180) - 90 AS DOUBLE) AS stop_lat,
               CAST((p_partkey * 104729 % 360) - 180 AS DOUBLE) AS stop_lon,
               CASE WHEN p_partkey % 101 = 0 THEN '999' WHEN p_partkey % 103 = 0 THEN 'abc'
                    ELSE CAST((p_partkey * 7919 % 180) - 90 AS VARCHAR) END AS stop_lat_text,
               CAST((p_partkey * 104729 % 360) - 180 AS VARCHAR) AS stop_lon_text,
               p_size
        FROM part""",
    "a_calendar": """
        SELECT 'F1' AS feed_id, s_suppkey AS service_id,
               CAST((s_suppkey >> 0) & 1 AS INTEGER) AS monday, CAST((s_suppkey >> 1) & 1 AS INTEGER) AS tuesday,
               CAST((s_suppkey >> 2) & 1 AS INTEGER) AS wednesday, CAST((s_suppkey >> 3) & 1 AS INTEGER) AS thursday,
               CAST((s_suppkey >> 4) & 1 AS INTEGER) AS friday, CAST((s_suppkey >> 5) & 1 AS INTEGER) AS saturday,
               CAST((s_suppkey >> 6) & 1 AS INTEGER) AS sunday,
               CAST(DATE '2024-01-01' + CAST(s_suppkey % 28 AS INTEGER) AS DATE) AS start_date,
               CAST(DATE '2024-01-01' + CAST(s_suppkey % 28 AS INTEGER) + 30 AS DATE) AS end_date
        FROM supplier""",
    "a_calendar_dates": """
        SELECT 'F1' AS feed_id, s_suppkey AS service_id,
               CAST(DATE '2024-01-01' + CAST(s_suppkey % 28 AS INTEGER) + 3 AS DATE) AS date,
               CAST(1 + s_suppkey % 2 AS INTEGER) AS exception_type
        FROM supplier""",
    "a_passengers": """
        SELECT 'F1' AS feed_id, event_id AS row_num, ts AS timestamp, event_type AS line_id,
               user_id AS stop_id, value AS number_of_validations
        FROM events""",
    "a_weather": """
        SELECT 'F1' AS feed_id, ts AS timestamp, value AS temperature_celsius, value / 10 AS precipitation_mm
        FROM events WHERE event_type = 'purchase'""",
    "a_holidays": """
        SELECT DISTINCT 'F1' AS feed_id, CAST(ts AS DATE) AS event_date, 'holiday' AS event_type
        FROM events WHERE event_type = 'signup' AND value >= 300""",
}

_ORDER = list(VIEWS)


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the adapter CTEs (and ``extra`` CTEs) it names."""
    ctes = dict(VIEWS)
    if extra:
        ctes.update(extra)
    used: list[str] = []

    def visit(text: str) -> None:
        for name in ctes:
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(ctes[name]) if name in (extra or {}) else None
                if name not in used:
                    used.append(name)

    visit(sql)
    if not used:
        return sql
    body = ",\n".join(f"{n} AS ({ctes[n]})" for n in used)
    stripped = sql.lstrip()
    if re.match(r"(?i)^with\s", stripped):
        return f"WITH {body},\n{stripped[4:].lstrip()}"
    return f"WITH {body}\n{sql}"
