"""Service calendar, analytics and restriction queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.operators import service as SV
from railyard.plans import adapters as A
from railyard.plans.registry import register

_ACTIVE_VIEW = {"active": """
    SELECT * FROM (
      (SELECT feed_id, service_id, date FROM (
         SELECT feed_id, service_id, CAST(start_date + CAST(i AS INTEGER) AS DATE) AS date,
                monday, tuesday, wednesday, thursday, friday, saturday, sunday
         FROM a_calendar, LATERAL generate_series(0, date_diff('day', start_date, end_date)) g(i))
       WHERE CASE isodow(date) WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday
                  WHEN 5 THEN friday WHEN 6 THEN saturday ELSE sunday END = 1
       EXCEPT
       SELECT feed_id, service_id, date FROM a_calendar_dates WHERE exception_type = 2)
      UNION
      SELECT feed_id, service_id, date FROM a_calendar_dates WHERE exception_type = 1)"""}


def _active(spark, sf):
    return SV.active_service_dates(A.a_calendar(spark, sf), A.a_calendar_dates(spark, sf))


@register("active_dates", sql="SELECT feed_id, service_id, date FROM active", extra_views=_ACTIVE_VIEW)
def active_dates(spark, sf):
    """AG-16 / SO-02: every (service, date) the service runs."""
    return _active(spark, sf)


@register(
    "active_date_span",
    sql="SELECT feed_id, min(date) AS start_date, max(date) AS end_date, count(DISTINCT date) AS active_dates "
        "FROM active GROUP BY feed_id",
    extra_views=_ACTIVE_VIEW,
)
def active_date_span(spark, sf):
    return SV.date_span(_active(spark, sf))


_TPD_SQL = """
    SELECT a.feed_id, a.date, count(*) AS num_trips
    FROM active a JOIN a_trips t ON t.feed_id = a.feed_id AND t.service_id = a.service_id
    GROUP BY a.feed_id, a.date"""


@register("trips_per_date", sql=_TPD_SQL, extra_views=_ACTIVE_VIEW)
def trips_per_date(spark, sf):
    return SV.trips_per_date(_active(spark, sf), A.a_trips(spark, sf))


@register(
    "busiest_date",
    sql=f"""
    SELECT feed_id, date AS busiest_date, num_trips FROM ({_TPD_SQL})
    QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY num_trips DESC, date) = 1
    """,
    extra_views=_ACTIVE_VIEW,
)
def busiest_date(spark, sf):
    return SV.busiest_date(SV.trips_per_date(_active(spark, sf), A.a_trips(spark, sf)))


@register(
    "feed_bounds",
    sql="""
    SELECT feed_id, min(stop_lon) AS min_lon, min(stop_lat) AS min_lat, max(stop_lon) AS max_lon, max(stop_lat) AS max_lat,
           round(avg(stop_lat), 6) AS centroid_lat, round(avg(stop_lon), 6) AS centroid_lon
    FROM a_stops GROUP BY feed_id
    """,
)
def feed_bounds(spark, sf):
    b = SV.bounds(A.a_stops(spark, sf))
    return b.select("feed_id", "min_lon", "min_lat", "max_lon", "max_lat",
                    F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lon", 6).alias("centroid_lon"))


@register(
    "feed_health",
    sql="""
    SELECT 'F1' AS feed_id, 'routes' AS indicator, (SELECT count(*) FROM a_routes) AS value
    UNION ALL SELECT 'F1', 'routes_without_trips',
      (SELECT count(*) FROM a_routes r WHERE NOT EXISTS (SELECT 1 FROM a_trips t WHERE t.route_id = r.route_id))
    UNION ALL SELECT 'F1', 'trips', (SELECT count(*) FROM a_trips)
    UNION ALL SELECT 'F1', 'trips_without_shape', (SELECT count(*) FROM a_trips)
    UNION ALL SELECT 'F1', 'stops', (SELECT count(*) FROM a_stops)
    UNION ALL SELECT 'F1', 'stops_without_trips',
      (SELECT count(*) FROM a_stops s WHERE NOT EXISTS (SELECT 1 FROM a_stop_times x WHERE x.stop_id = s.stop_id))
    UNION ALL SELECT 'F1', 'stop_times_without_departure', (SELECT count(*) FROM a_stop_times WHERE departure_secs IS NULL)
    UNION ALL SELECT 'F1', 'stop_times_without_arrival', (SELECT count(*) FROM a_stop_times WHERE arrival_secs IS NULL)
    """,
)
def feed_health(spark, sf):
    tables = {"routes": A.a_routes(spark, sf), "trips": A.a_trips(spark, sf), "stops": A.a_stops(spark, sf),
              "stop_times": A.a_stop_times(spark, sf)}
    return SV.health(tables)


_ST_ORDER = ", ".join(A.stop_time_order_cols())


@register(
    "route_stats",
    sql=f"""
    WITH fd AS (SELECT feed_id, min(date) AS date FROM active GROUP BY feed_id),
         svc AS (SELECT DISTINCT a.feed_id, a.service_id FROM active a JOIN fd USING (feed_id, date)),
         st AS (SELECT * REPLACE (CASE WHEN trip_id % 3 <> 0 THEN shape_dist_traveled END AS shape_dist_traveled) FROM a_stop_times),
         pos AS (SELECT feed_id, stop_id, radians(CAST(stop_lat AS DOUBLE)) AS lat, radians(CAST(stop_lon AS DOUBLE)) AS lon FROM a_stops),
         legs AS (SELECT feed_id, trip_id, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM st JOIN pos USING (feed_id, stop_id)
                  WINDOW w AS (PARTITION BY feed_id, trip_id ORDER BY stop_sequence, {_ST_ORDER})),
         path AS (SELECT feed_id, trip_id, sum(6371.0 * atan2(sqrt(pow(cos(lat) * sin(lon - lon0), 2) + pow(cos(lat0) * sin(lat) - sin(lat0) * cos(lat) * cos(lon - lon0), 2)),
                                                               sin(lat0) * sin(lat) + cos(lat0) * cos(lat) * cos(lon - lon0))) AS km
                  FROM legs GROUP BY feed_id, trip_id),
         pt AS (SELECT feed_id, trip_id, min(arrival_secs) AS s, max(arrival_secs) AS e, coalesce(max(shape_dist_traveled), max(km)) AS d
                FROM st LEFT JOIN path USING (feed_id, trip_id) GROUP BY feed_id, trip_id),
         t AS (SELECT t.feed_id, t.trip_id, t.route_id, t.direction_id, pt.s, pt.e, pt.d
               FROM a_trips t JOIN svc USING (feed_id, service_id) JOIN pt USING (feed_id, trip_id)),
         g AS (SELECT *, s - lag(s) OVER (PARTITION BY feed_id, route_id, direction_id ORDER BY s, trip_id) AS gap FROM t)
    SELECT g.feed_id, fd.date, route_id, count(*) AS num_trips, round(avg(gap) / 60.0, 6) AS mean_headway,
           round(sum((e - s) / 3600.0), 6) AS service_duration, round(round(sum(d), 6), 3) AS service_distance,
           round(round(CASE WHEN sum((e - s) / 3600.0) > 0 THEN sum(d) / sum((e - s) / 3600.0) END, 6), 3) AS service_speed
    FROM g JOIN fd USING (feed_id) GROUP BY g.feed_id, fd.date, route_id
    """,
    extra_views=_ACTIVE_VIEW,
)
def route_stats(spark, sf):
    """AG-18: a third of the trips have no shape distance; theirs is summed from stop to stop (metres are shown,
    as sines differ in the last bits between engines)."""
    st = A.a_stop_times(spark, sf)
    st = st.withColumn("shape_dist_traveled", F.when(F.col("trip_id") % 3 != 0, F.col("shape_dist_traveled")))
    out = SV.route_stats(_active(spark, sf), A.a_trips(spark, sf), st, A.a_stops(spark, sf), ["stop_sequence", *A.stop_time_order_cols()])
    return out.withColumns({c: F.round(c, 3) for c in ("service_distance", "service_speed")})


def _feed(spark, sf):
    return {"agency": A.a_agency(spark, sf), "routes": A.a_routes(spark, sf), "trips": A.a_trips(spark, sf),
            "stop_times": A.a_stop_times(spark, sf), "stops": A.a_stops(spark, sf),
            "calendar": A.a_calendar(spark, sf), "calendar_dates": A.a_calendar_dates(spark, sf)}


_COUNTS = """
    SELECT 'F1' AS feed_id, 'trips' AS table_name, count(*) AS records FROM t
    UNION ALL SELECT 'F1', 'stop_times', count(*) FROM st
    UNION ALL SELECT 'F1', 'stops', count(*) FROM s
    UNION ALL SELECT 'F1', 'routes', count(*) FROM ro
    UNION ALL SELECT 'F1', 'agency', count(*) FROM ag
    UNION ALL SELECT 'F1', 'calendar', count(*) FROM cal
    UNION ALL SELECT 'F1', 'calendar_dates', count(*) FROM cd"""
_KEYS = {"trips": ["trip_id"], "stop_times": ["trip_id", "stop_sequence", "stop_id"], "stops": ["stop_id"],
         "routes": ["route_id"], "agency": ["agency_id"], "calendar": ["service_id"], "calendar_dates": ["service_id", "date"]}
_ROWS = "\n    UNION ALL ".join(
    f"SELECT 'F1' AS feed_id, '{t}' AS table_name, concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in _KEYS[t])}) AS row_key FROM {v}"
    for t, v in zip(_KEYS, ("t", "st", "s", "ro", "ag", "cal", "cd")))


def _rows_of(tables) -> DataFrame:
    """The key of every kept row of every table."""
    out = None
    for t, names in _KEYS.items():
        part = tables[t].select("feed_id", F.lit(t).alias("table_name"),
                                F.concat_ws("|", *[F.col(c).cast("string") for c in names]).alias("row_key"))
        out = part if out is None else out.unionByName(part)
    return out


def _cascade_sql(trips_filter: str, result: str = _COUNTS) -> str:
    return f"""
    WITH t AS (SELECT * FROM a_trips WHERE {trips_filter}),
         st AS (SELECT * FROM a_stop_times WHERE trip_id IN (SELECT trip_id FROM t)),
         used AS (SELECT DISTINCT stop_id FROM st),
         s AS (SELECT * FROM a_stops WHERE stop_id IN (SELECT stop_id FROM used)
               OR stop_id IN (SELECT parent_station FROM a_stops WHERE stop_id IN (SELECT stop_id FROM used)
                                                                  AND parent_station IS NOT NULL)),
         ro AS (SELECT * FROM a_routes WHERE route_id IN (SELECT route_id FROM t)),
         ag AS (SELECT * FROM a_agency WHERE agency_id IN (SELECT agency_id FROM ro)
                OR EXISTS (SELECT 1 FROM ro WHERE agency_id IS NULL)),
         cal AS (SELECT * FROM a_calendar WHERE service_id IN (SELECT service_id FROM t)),
         cd AS (SELECT * FROM a_calendar_dates WHERE service_id IN (SELECT service_id FROM t))
    {result}"""


@register(
    "restrict_routes_counts",
    sql=_cascade_sql("route_id IN (SELECT route_id FROM a_routes WHERE route_long_name = 'BUILDING')"),
)
def restrict_routes_counts(spark, sf):
    """JN-12: the feed restricted to the BUILDING-segment routes."""
    routes = A.a_routes(spark, sf).where(F.col("route_long_name") == "BUILDING").select("feed_id", "route_id")
    return SV.counts_of(SV.restrict_to_routes(_feed(spark, sf), routes))


@register(
    "restrict_routes_rows",
    sql=_cascade_sql("route_id IN (SELECT route_id FROM a_routes WHERE route_long_name = 'BUILDING')", _ROWS),
)
def restrict_routes_rows(spark, sf):
    """JN-12: the key of every row that the restriction to BUILDING routes keeps."""
    routes = A.a_routes(spark, sf).where(F.col("route_long_name") == "BUILDING").select("feed_id", "route_id")
    return _rows_of(SV.restrict_to_routes(_feed(spark, sf), routes))


WANTED_DATES = [dt.date(2024, 1, 10), dt.date(2024, 1, 11)]


@register(
    "restrict_dates_counts",
    sql=_cascade_sql("service_id IN (SELECT service_id FROM active WHERE date IN (DATE '2024-01-10', DATE '2024-01-11'))"),
    extra_views=_ACTIVE_VIEW,
)
def restrict_dates_counts(spark, sf):
    """JN-13: the feed restricted to services running on 10 or 11 January 2024."""
    dates = spark.createDataFrame([(A.FEED_ID, d) for d in WANTED_DATES], "feed_id string, date date")
    return SV.counts_of(SV.restrict_to_dates(_feed(spark, sf), dates))


@register(
    "restrict_dates_rows",
    sql=_cascade_sql("service_id IN (SELECT service_id FROM active WHERE date IN (DATE '2024-01-10', DATE '2024-01-11'))", _ROWS),
    extra_views=_ACTIVE_VIEW,
)
def restrict_dates_rows(spark, sf):
    """JN-13: the key of every row that the restriction to two dates keeps."""
    dates = spark.createDataFrame([(A.FEED_ID, d) for d in WANTED_DATES], "feed_id string, date date")
    return _rows_of(SV.restrict_to_dates(_feed(spark, sf), dates))
