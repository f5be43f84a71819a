"""NeTEx translation queries over the adapter feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.functions import scalars as S
from railyard.operators import netex as NX
from railyard.plans import adapters as A
from railyard.plans.registry import register

CFG = NX.NetexConfig(
    codespace="RY",
    authority=NX.Organisation("AUTH", "Transit Authority", "TA", "authority@example.org"),
    operator=NX.Organisation("OP1", "Operator One", "OP1"),
)
ORDER = A.stop_time_order_cols()
_ORDER_SQL = ", ".join(ORDER)


def _urn(kind: str, local_sql: str) -> str:
    return f"'PT:RY:{kind}:' || regexp_replace(CAST({local_sql} AS VARCHAR), '[^A-Za-z0-9_\\-]', '_', 'g')"


_MODE_CASE = ("CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 2 THEN 'rail' WHEN 3 THEN 'bus' "
              "WHEN 4 THEN 'water' WHEN 5 THEN 'cableway' WHEN 6 THEN 'cableway' WHEN 7 THEN 'funicular' "
              "WHEN 11 THEN 'trolleyBus' WHEN 12 THEN 'metro' END")

_MODES_VIEW = {"stop_mode": f"""
    SELECT feed_id, stop_id, mode FROM (
      SELECT x.feed_id, x.stop_id, rm.mode, {_ORDER_SQL},
             count(*) OVER (PARTITION BY x.feed_id, x.stop_id, rm.mode) AS n,
             row_number() OVER (PARTITION BY x.feed_id, x.stop_id, rm.mode ORDER BY {_ORDER_SQL}) AS rn
      FROM a_stop_times x JOIN a_trips t ON t.feed_id = x.feed_id AND t.trip_id = x.trip_id
      JOIN (SELECT feed_id, route_id, {_MODE_CASE} AS mode FROM a_routes) rm
        ON rm.feed_id = t.feed_id AND rm.route_id = t.route_id
      WHERE rm.mode IS NOT NULL)
    WHERE rn = 1
    QUALIFY row_number() OVER (PARTITION BY feed_id, stop_id ORDER BY n DESC, {_ORDER_SQL}) = 1"""}


def _modes(spark, sf):
    return NX.stop_modes(A.a_routes(spark, sf), A.a_trips(spark, sf), A.a_stop_times(spark, sf), ORDER)


@register("stop_modes", sql="SELECT feed_id, stop_id, mode FROM stop_mode", extra_views=_MODES_VIEW)
def stop_modes(spark, sf):
    """JN-14 / AG-10: modal vehicle mode of each served stop."""
    return _modes(spark, sf)


@register(
    "stop_hierarchy",
    sql=f"""
    WITH s AS (SELECT feed_id, CAST(stop_id AS VARCHAR) AS stop_id, stop_id AS ord, stop_name,
                      CAST(parent_station AS VARCHAR) AS parent_station, coalesce(location_type, 0) AS lt FROM a_stops),
         m AS (SELECT feed_id, CAST(stop_id AS VARCHAR) AS stop_id, mode FROM stop_mode),
         q AS (SELECT s.*, p.lt AS plt, p.stop_name AS pname, m.mode
               FROM s LEFT JOIN s p ON p.feed_id = s.feed_id AND p.stop_id = s.parent_station
                      LEFT JOIN m ON m.feed_id = s.feed_id AND m.stop_id = s.stop_id
               WHERE s.lt = 0),
         qk AS (SELECT *, CASE WHEN parent_station IS NOT NULL AND plt IS NOT NULL THEN parent_station
                               ELSE stop_id || '_place' END AS place_key,
                          CASE WHEN parent_station IS NOT NULL AND plt IS NOT NULL THEN coalesce(pname, parent_station)
                               ELSE coalesce(stop_name, stop_id) END AS qname,
                          {_urn('Quay', 'stop_id')} AS quay_id FROM q),
         pm AS (SELECT feed_id, place_key, mode FROM (
                  SELECT feed_id, place_key, mode, count(*) AS n, min(ord) AS first FROM qk WHERE mode IS NOT NULL
                  GROUP BY feed_id, place_key, mode)
                QUALIFY row_number() OVER (PARTITION BY feed_id, place_key ORDER BY n DESC, first) = 1),
         g AS (SELECT feed_id, place_key, any_value(qname) AS name, count(*) AS n_quays,
                      string_agg(quay_id, ' ' ORDER BY ord) AS quay_ids FROM qk GROUP BY feed_id, place_key),
         st AS (SELECT feed_id, stop_id AS place_key, coalesce(stop_name, stop_id) AS name FROM s WHERE lt = 1)
    SELECT g.feed_id, g.place_key, {_urn('StopPlace', 'g.place_key')} AS id, coalesce(st.name, g.name) AS name,
           coalesce(pm.mode, 'other') AS transport_mode, CAST(n_quays AS INTEGER) AS n_quays, quay_ids
    FROM g LEFT JOIN st ON st.feed_id = g.feed_id AND st.place_key = g.place_key
           LEFT JOIN pm ON pm.feed_id = g.feed_id AND pm.place_key = g.place_key
    UNION ALL
    SELECT feed_id, place_key, {_urn('StopPlace', 'place_key')}, name, 'other', 0, ''
    FROM st WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.feed_id = st.feed_id AND g.place_key = st.place_key)
    """,
    extra_views=_MODES_VIEW,
)
def stop_hierarchy(spark, sf):
    """JN-15 / PRJ-20: stations, quays under them, places made for non-station
    parents and for orphans."""
    places = NX.stop_places(A.a_stops(spark, sf), _modes(spark, sf), CFG, ["stop_id"])
    return places.select("feed_id", "place_key", "id", "name", "transport_mode",
                         F.size("quays").alias("n_quays"),
                         F.array_join(F.transform("quays", lambda q: q["id"]), " ").alias("quay_ids"))


_PATTERN_VIEWS = {
    "tl": f"""
        SELECT feed_id, trip_id, string_agg(CAST(stop_id AS VARCHAR), ' ' ORDER BY stop_sequence, {_ORDER_SQL}) AS stops,
               count(*) AS n_stops
        FROM a_pattern_stop_times GROUP BY feed_id, trip_id""",
    "tp": """
        SELECT a.feed_id, a.trip_id, a.route_id, a.direction_id, a.row_num, tl.stops, tl.n_stops
        FROM a_trips a JOIN tl ON tl.feed_id = a.feed_id AND tl.trip_id = a.trip_id""",
    "pats": """
        SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY first) AS num FROM (
          SELECT feed_id, route_id, direction_id, stops, any_value(n_stops) AS n_stops, min(row_num) AS first,
                 count(*) AS n_trips
          FROM tp GROUP BY feed_id, route_id, direction_id, stops)""",
}


def _patterns(spark, sf):
    st = A.a_stop_times(spark, sf, pattern_stops=True)
    return NX.journey_patterns(A.a_trips(spark, sf), st, CFG, ["row_num"], ORDER)


@register(
    "journey_patterns",
    sql=f"""
    SELECT feed_id, printf('%s_%d_%d', CAST(route_id AS VARCHAR), coalesce(direction_id, 0), num) AS local_id,
           {_urn('JourneyPattern', "printf('%s_%d_%d', CAST(route_id AS VARCHAR), coalesce(direction_id, 0), num)")} AS id,
           route_id, direction_id,
           CASE WHEN coalesce(direction_id, 0) = 0 THEN 'outbound' ELSE 'inbound' END AS direction_type,
           stops, CAST(n_stops AS INTEGER) AS n_stops, n_trips
    FROM pats
    """,
    extra_views=_PATTERN_VIEWS,
)
def journey_patterns(spark, sf):
    """AG-11 / WN-06: distinct (route, direction, stop list) patterns."""
    pats, _ = _patterns(spark, sf)
    return pats.select("feed_id", "local_id", "id", "route_id", "direction_id", "direction_type",
                       F.array_join(F.transform("stops", lambda x: x.cast("string")), " ").alias("stops"),
                       "n_stops", "n_trips")


@register(
    "trip_patterns",
    sql="""
    SELECT tp.feed_id, tp.trip_id, printf('%s_%d_%d', CAST(p.route_id AS VARCHAR), coalesce(p.direction_id, 0), p.num) AS local_id
    FROM tp JOIN pats p ON p.feed_id = tp.feed_id AND p.route_id = tp.route_id
                       AND p.direction_id IS NOT DISTINCT FROM tp.direction_id AND p.stops = tp.stops
    """,
    extra_views=_PATTERN_VIEWS,
)
def trip_patterns(spark, sf):
    """JN-16: each trip's journey pattern."""
    _, t2p = _patterns(spark, sf)
    return t2p.select("feed_id", "trip_id", "local_id")


def _timed_stop_times(spark, sf):
    st = A.a_stop_times(spark, sf, pattern_stops=True)
    return st.withColumn("arrival_time", S.seconds_to_time("arrival_secs")).withColumn(
        "departure_time", S.seconds_to_time("departure_secs"))


@register(
    "passing_times",
    sql=f"""
    WITH tpl AS (SELECT tp.feed_id, tp.trip_id, printf('%s_%d_%d', CAST(p.route_id AS VARCHAR), coalesce(p.direction_id, 0), p.num) AS local_id
                 FROM tp JOIN pats p ON p.feed_id = tp.feed_id AND p.route_id = tp.route_id
                                    AND p.direction_id IS NOT DISTINCT FROM tp.direction_id AND p.stops = tp.stops),
         x AS (SELECT s.*, tpl.local_id,
                      row_number() OVER (PARTITION BY s.feed_id, s.trip_id ORDER BY stop_sequence, {_ORDER_SQL}) AS idx
               FROM a_pattern_stop_times s JOIN tpl ON tpl.feed_id = s.feed_id AND tpl.trip_id = s.trip_id)
    SELECT feed_id, trip_id, idx, {_urn('TimetabledPassingTime', "CAST(trip_id AS VARCHAR) || '_' || CAST(idx AS VARCHAR)")} AS id,
           {_urn('StopPointInJourneyPattern', "local_id || '_' || CAST(idx AS VARCHAR)")} AS spjp_ref,
           printf('%02d:%02d:%02d', (arrival_secs // 3600) % 24, (arrival_secs % 3600) // 60, arrival_secs % 60)
             AS arrival_time,
           CAST(arrival_secs // 86400 AS INTEGER) AS arrival_day_offset,
           printf('%02d:%02d:%02d', (departure_secs // 3600) % 24, (departure_secs % 3600) // 60, departure_secs % 60)
             AS departure_time,
           CAST(departure_secs // 86400 AS INTEGER) AS departure_day_offset
    FROM x
    """,
    extra_views=_PATTERN_VIEWS,
)
def passing_times(spark, sf):
    """JN-18 / SC-11: passing times with day offsets past midnight."""
    _, t2p = _patterns(spark, sf)
    return NX.passing_times(_timed_stop_times(spark, sf), t2p, CFG, ORDER)


@register(
    "journeys_per_line",
    sql=f"""
    SELECT feed_id, {_urn('Line', 'route_id')} AS line_ref, count(*) AS n_journeys FROM tp GROUP BY feed_id, route_id
    """,
    extra_views=_PATTERN_VIEWS,
)
def journeys_per_line(spark, sf):
    """AG-20: service journeys per line (one timetable document each)."""
    _, t2p = _patterns(spark, sf)
    return NX.journeys_per_line(NX.service_journeys(A.a_trips(spark, sf), t2p, CFG))


def _fold(spark, sf):
    return NX.calendar_fold(A.a_calendar(spark, sf), A.a_calendar_dates(spark, sf), CFG, ["service_id"], ["service_id"])


@register(
    "calendar_fold",
    sql=f"""
    WITH sids AS (SELECT feed_id, CAST(service_id AS VARCHAR) AS service_id FROM a_calendar
                  UNION SELECT feed_id, CAST(service_id AS VARCHAR) FROM a_calendar_dates),
         dow AS (SELECT feed_id, CAST(service_id AS VARCHAR) AS service_id,
                        concat_ws(' ', CASE WHEN monday = 1 THEN 'Monday' END, CASE WHEN tuesday = 1 THEN 'Tuesday' END,
                                  CASE WHEN wednesday = 1 THEN 'Wednesday' END, CASE WHEN thursday = 1 THEN 'Thursday' END,
                                  CASE WHEN friday = 1 THEN 'Friday' END, CASE WHEN saturday = 1 THEN 'Saturday' END,
                                  CASE WHEN sunday = 1 THEN 'Sunday' END) AS days_of_week FROM a_calendar)
    SELECT s.feed_id, s.service_id, {_urn('DayType', 's.service_id')} AS id, s.service_id AS name,
           coalesce(d.days_of_week, '') AS days_of_week
    FROM sids s LEFT JOIN dow d ON d.feed_id = s.feed_id AND d.service_id = s.service_id
    """,
)
def calendar_fold(spark, sf):
    """JN-17 / SC-16: one DayType per service with its weekdays."""
    day_types, _, _ = _fold(spark, sf)
    return day_types


@register(
    "day_type_assignments",
    sql=f"""
    WITH a1 AS (SELECT feed_id, service_id, row_number() OVER (PARTITION BY feed_id ORDER BY service_id) AS ord
                FROM a_calendar),
         n1 AS (SELECT feed_id, count(*) AS n FROM a_calendar GROUP BY feed_id),
         a2 AS (SELECT c.feed_id, c.service_id, c.date, c.exception_type,
                       row_number() OVER (PARTITION BY c.feed_id ORDER BY c.service_id) + coalesce(n1.n, 0) AS ord
                FROM a_calendar_dates c LEFT JOIN n1 ON n1.feed_id = c.feed_id)
    SELECT feed_id, {_urn('DayTypeAssignment', "CAST(service_id AS VARCHAR) || '_period'")} AS id, ord AS "order",
           {_urn('DayType', 'service_id')} AS day_type_ref, {_urn('OperatingPeriod', 'service_id')} AS operating_period_ref,
           CAST(NULL AS VARCHAR) AS date, true AS is_available
    FROM a1
    UNION ALL
    SELECT feed_id, {_urn('DayTypeAssignment', "CAST(service_id AS VARCHAR) || '_' || strftime(date, '%Y%m%d')")},
           ord, {_urn('DayType', 'service_id')}, NULL, strftime(date, '%Y-%m-%d'), exception_type = 1
    FROM a2
    """,
)
def day_type_assignments(spark, sf):
    """JN-17 / WN-06: period assignments, then dated exceptions, numbered per feed."""
    _, _, assignments = _fold(spark, sf)
    return assignments


@register(
    "netex_validity",
    sql="""
    SELECT feed_id, strftime(min(start_date), '%Y-%m-%d') AS from_date, strftime(max(end_date), '%Y-%m-%d') AS to_date
    FROM a_calendar GROUP BY feed_id
    """,
)
def netex_validity(spark, sf):
    """AG-12: validity window of the calendar."""
    _, periods, _ = _fold(spark, sf)
    return NX.validity(periods)


@register(
    "netex_lines",
    sql=f"""
    SELECT feed_id, CAST(route_id AS VARCHAR) AS route_id, {_urn('Line', 'route_id')} AS id,
           coalesce(nullif(route_long_name, ''), nullif(route_short_name, ''), CAST(route_id AS VARCHAR)) AS name,
           route_short_name AS public_code, {_MODE_CASE} AS transport_mode,
           {_urn('Operator', "coalesce(CAST(agency_id AS VARCHAR), 'OP1')")} AS operator_ref
    FROM a_routes
    """,
)
def netex_lines(spark, sf):
    """PRJ-18 / SC-17: one Line per route (unmapped route types give a NULL mode)."""
    return NX.lines(A.a_routes(spark, sf), CFG).select("feed_id", "route_id", "id", "name", "public_code",
                                                       "transport_mode", "operator_ref")


@register(
    "netex_preflight",
    sql=f"""
    SELECT feed_id, 'error' AS severity,
           'Route ''' || CAST(route_id AS VARCHAR) || ''' has unmapped route_type ' || CAST(route_type AS VARCHAR) AS message
    FROM a_routes WHERE ({_MODE_CASE}) IS NULL
    """,
)
def netex_preflight(spark, sf):
    """PRJ-21: routes the export would refuse."""
    return NX.preflight(A.a_routes(spark, sf), CFG)


@register(
    "netex_organisations",
    sql=f"""
    SELECT DISTINCT feed_id, {_urn('Authority', "'AUTH'")} AS id, 'Authority' AS kind, 'Transit Authority' AS name,
           'TA' AS short_name, 'authority@example.org' AS contact_email FROM a_agency
    UNION ALL
    SELECT DISTINCT feed_id, {_urn('Operator', "'OP1'")}, 'Operator', 'Operator One', 'OP1', NULL FROM a_agency
    UNION ALL
    SELECT feed_id, {_urn('Operator', 'oid')}, 'Operator', coalesce(agency_name, oid), NULL, NULL FROM (
      SELECT feed_id, coalesce(CAST(agency_id AS VARCHAR), 'OP1') AS oid, agency_name, agency_id FROM a_agency)
    WHERE oid <> 'OP1'
    QUALIFY row_number() OVER (PARTITION BY feed_id, oid ORDER BY agency_id) = 1
    """,
)
def netex_organisations(spark, sf):
    """PRJ-19: authority, primary operator, one operator per further agency."""
    return NX.organisations(A.a_agency(spark, sf), CFG, ["agency_id"])


@register(
    "stop_assignments",
    sql=f"""
    SELECT feed_id, CAST(stop_id AS VARCHAR) AS stop_id, {_urn('ScheduledStopPoint', 'stop_id')} AS ssp_id,
           stop_name AS name, {_urn('PassengerStopAssignment', 'stop_id')} AS psa_id,
           row_number() OVER (PARTITION BY feed_id ORDER BY stop_id) AS "order", {_urn('Quay', 'stop_id')} AS quay_ref
    FROM a_stops WHERE coalesce(location_type, 0) = 0
    """,
)
def stop_assignments(spark, sf):
    """JN-19 / WN-06: scheduled stop points and their quay assignments, numbered per feed."""
    return NX.stop_points(A.a_stops(spark, sf), CFG, ["stop_id"])


@register(
    "pattern_stop_points",
    sql=f"""
    WITH p AS (SELECT printf('%s_%d_%d', CAST(route_id AS VARCHAR), coalesce(direction_id, 0), num) AS local_id, feed_id,
                      string_split(stops, ' ') AS s FROM pats),
         x AS (SELECT feed_id, local_id, unnest(s) AS stop_id, unnest(range(1, len(s) + 1)) AS ord FROM p)
    SELECT feed_id, local_id, CAST(ord AS INTEGER) AS "order",
           {_urn('StopPointInJourneyPattern', "local_id || '_' || CAST(ord AS VARCHAR)")} AS id,
           {_urn('ScheduledStopPoint', 'stop_id')} AS ssp_ref
    FROM x
    """,
    extra_views=_PATTERN_VIEWS,
)
def pattern_stop_points(spark, sf):
    """NX-16 data: the ordered stop points of every journey pattern."""
    pats, _ = _patterns(spark, sf)
    return NX.stop_points_in_pattern(pats, CFG)
