"""Validator and row-validation queries over raw-text views of the adapters.

Seeded faults are derived from the data (segment, balance, key arithmetic),
never by dropping rows: every row of every table is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard import schemas
from railyard.functions import scalars as S
from railyard.operators import ordered
from railyard.operators import validate as V
from railyard.plans import adapters as A
from railyard.plans.registry import register

ISSUE_SQL_COLS = "feed_id, severity, file_name, field, row_index, message"

RAW_VIEWS = {
    "raw_routes": """
        SELECT 'F1' AS feed_id, c_custkey AS row_num, CAST(c_custkey AS VARCHAR) AS route_id,
               CAST(c_nationkey AS VARCHAR) AS agency_id,
               CASE WHEN c_acctbal < 0 THEN 'unknown'
                    ELSE CASE c_mktsegment WHEN 'BUILDING' THEN '3' WHEN 'AUTOMOBILE' THEN '11'
                         WHEN 'MACHINERY' THEN '2' WHEN 'HOUSEHOLD' THEN '700' ELSE '' END END AS route_type,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'FF0000' WHEN 'AUTOMOBILE' THEN '00ff00'
                    WHEN 'MACHINERY' THEN '#0000FF' WHEN 'HOUSEHOLD' THEN 'FFF' END AS route_color
        FROM customer""",
    "raw_trips": """
        SELECT feed_id, row_num, CAST(trip_id AS VARCHAR) AS trip_id, CAST(route_id AS VARCHAR) AS route_id,
               CAST(service_id AS VARCHAR) AS service_id
        FROM a_trips""",
    "raw_stops": """
        SELECT feed_id, stop_id AS row_num, CAST(stop_id AS VARCHAR) AS stop_id, stop_lat_text AS stop_lat,
               stop_lon_text AS stop_lon
        FROM a_stops""",
    "raw_calendar": """
        SELECT feed_id, service_id AS row_num, CAST(service_id AS VARCHAR) AS service_id,
               CASE WHEN service_id % 7 = 0 THEN strftime(end_date, '%Y%m%d') ELSE strftime(start_date, '%Y%m%d') END
                 AS start_date,
               CASE WHEN service_id % 11 = 0 THEN strftime(end_date, '%Y%m') || '32'
                    WHEN service_id % 7 = 0 THEN strftime(start_date, '%Y%m%d')
                    ELSE strftime(end_date, '%Y%m%d') END AS end_date
        FROM a_calendar""",
    "raw_calendar_dates": """
        SELECT feed_id, service_id AS row_num, CAST(service_id AS VARCHAR) AS service_id,
               CASE WHEN service_id % 13 = 0 THEN strftime(date, '%Y-%m-%d') ELSE strftime(date, '%Y%m%d') END AS date,
               CAST(exception_type AS VARCHAR) AS exception_type
        FROM a_calendar_dates""",
    "raw_agency": """
        SELECT feed_id, agency_id AS row_num, CAST(agency_id AS VARCHAR) AS agency_id, agency_name FROM a_agency""",
    "raw_numbered_stop_times": """
        SELECT s.feed_id, row_number() OVER (PARTITION BY s.feed_id ORDER BY l_shipdate, l_suppkey, l_partkey, l_extendedprice,
                                             l_quantity, l_discount, l_tax) AS row_num,
               CAST(trip_id AS VARCHAR) AS trip_id, CAST(stop_id AS VARCHAR) AS stop_id,
               CAST(stop_sequence AS VARCHAR) AS stop_sequence,
               CASE WHEN stop_sequence = 7 THEN printf('%d:%02d', arrival_secs // 3600, (arrival_secs % 3600) // 60)
                    ELSE printf('%02d:%02d:%02d', arrival_secs // 3600, (arrival_secs % 3600) // 60, arrival_secs % 60)
               END AS arrival_time,
               printf('%02d:%02d:%02d', departure_secs // 3600, (departure_secs % 3600) // 60, departure_secs % 60)
                 AS departure_time
        FROM a_stop_times s""",
    "raw_stop_times": """
        SELECT feed_id, CAST(trip_id AS VARCHAR) AS trip_id, stop_sequence,
               CASE WHEN stop_sequence = 7 THEN printf('%d:%02d', arrival_secs // 3600, (arrival_secs % 3600) // 60)
                    ELSE printf('%02d:%02d:%02d', arrival_secs // 3600, (arrival_secs % 3600) // 60, arrival_secs % 60)
               END AS arrival_time,
               printf('%02d:%02d:%02d', departure_secs // 3600, (departure_secs % 3600) // 60, departure_secs % 60)
                 AS departure_time
        FROM a_stop_times""",
}


# --- Spark raw views -------------------------------------------------------------
def raw_routes(spark, sf):
    c = A.table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    rtype = (F.when(F.col("c_acctbal") < 0, F.lit("unknown"))
             .otherwise(F.when(seg == "BUILDING", "3").when(seg == "AUTOMOBILE", "11").when(seg == "MACHINERY", "2")
                        .when(seg == "HOUSEHOLD", "700").otherwise("")))
    color = (F.when(seg == "BUILDING", "FF0000").when(seg == "AUTOMOBILE", "00ff00")
             .when(seg == "MACHINERY", "#0000FF").when(seg == "HOUSEHOLD", "FFF"))
    return c.select(F.lit(A.FEED_ID).alias("feed_id"), F.col("c_custkey").alias("row_num"),
                    F.col("c_custkey").cast("string").alias("route_id"),
                    F.col("c_nationkey").cast("string").alias("agency_id"),
                    rtype.alias("route_type"), color.alias("route_color"))


def raw_trips(spark, sf):
    t = A.a_trips(spark, sf)
    return t.select("feed_id", "row_num", *[F.col(c).cast("string").alias(c) for c in ("trip_id", "route_id", "service_id")])


def raw_stops(spark, sf):
    s = A.a_stops(spark, sf)
    return s.select("feed_id", F.col("stop_id").alias("row_num"), F.col("stop_id").cast("string").alias("stop_id"),
                    F.col("stop_lat_text").alias("stop_lat"), F.col("stop_lon_text").alias("stop_lon"))


def raw_calendar(spark, sf):
    c = A.a_calendar(spark, sf)
    sid = F.col("service_id")
    ymd = lambda c_: F.date_format(c_, "yyyyMMdd")
    start = F.when(sid % 7 == 0, ymd("end_date")).otherwise(ymd("start_date"))
    end = (F.when(sid % 11 == 0, F.concat(F.date_format("end_date", "yyyyMM"), F.lit("32")))
           .when(sid % 7 == 0, ymd("start_date")).otherwise(ymd("end_date")))
    return c.select("feed_id", sid.alias("row_num"), sid.cast("string").alias("service_id"),
                    start.alias("start_date"), end.alias("end_date"))


def raw_calendar_dates(spark, sf):
    c = A.a_calendar_dates(spark, sf)
    sid = F.col("service_id")
    d = F.when(sid % 13 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "yyyyMMdd"))
    return c.select("feed_id", sid.alias("row_num"), sid.cast("string").alias("service_id"), d.alias("date"),
                    F.col("exception_type").cast("string").alias("exception_type"))


def raw_stop_times(spark, sf):
    st = A.a_stop_times(spark, sf)
    a = F.col("arrival_secs")
    short = F.format_string("%d:%02d", F.floor(a / 3600), F.floor((a % 3600) / 60))
    arr = F.when(F.col("stop_sequence") == 7, short).otherwise(S.seconds_to_time(a))
    return st.select("feed_id", F.col("trip_id").cast("string").alias("trip_id"), "stop_sequence",
                     arr.alias("arrival_time"), S.seconds_to_time("departure_secs").alias("departure_time"))


def raw_agency(spark, sf):
    return A.a_agency(spark, sf).select("feed_id", F.col("agency_id").alias("row_num"),
                                        F.col("agency_id").cast("string").alias("agency_id"), "agency_name")


def raw_numbered_stop_times(spark, sf):
    """Every stop_time with its row number in input order."""
    st = ordered.dense_ordinal(A.a_stop_times(spark, sf), ["feed_id"], A.stop_time_order_cols(), "row_num")
    a = F.col("arrival_secs")
    short = F.format_string("%d:%02d", F.floor(a / 3600), F.floor((a % 3600) / 60))
    return st.select("feed_id", "row_num", *[F.col(c).cast("string").alias(c) for c in ("trip_id", "stop_id", "stop_sequence")],
                     F.when(F.col("stop_sequence") == 7, short).otherwise(S.seconds_to_time(a)).alias("arrival_time"),
                     S.seconds_to_time("departure_secs").alias("departure_time"))


def raw_feed(spark, sf):
    """All validated files of the feed as raw text tables."""
    return {
        "agency.txt": raw_agency(spark, sf),
        "stops.txt": raw_stops(spark, sf),
        "routes.txt": raw_routes(spark, sf),
        "trips.txt": raw_trips(spark, sf),
        "stop_times.txt": raw_numbered_stop_times(spark, sf),
        "calendar.txt": raw_calendar(spark, sf),
        "calendar_dates.txt": raw_calendar_dates(spark, sf),
    }


def _issues(frames):
    return V.union_issues([f.select(*V.ISSUE_COLS) for f in frames])


# --- queries -----------------------------------------------------------------------
@register(
    "required_fields",
    sql=f"""
    SELECT DISTINCT feed_id, 'error' AS severity, 'agency.txt' AS file_name, f AS field, CAST(NULL AS BIGINT) AS row_index,
           'Required field ''' || f || ''' missing from header' AS message
    FROM a_agency, (VALUES ('agency_url'), ('agency_timezone')) v(f)
    UNION ALL
    SELECT feed_id, 'error', 'routes.txt', 'route_type', row_num, 'Required field ''route_type'' is empty'
    FROM raw_routes WHERE route_type IS NULL OR trim(route_type) = ''
    """,
    extra_views=RAW_VIEWS,
)
def required_fields(spark, sf):
    tables = {
        "agency.txt": A.a_agency(spark, sf).withColumn("row_num", F.col("agency_id").cast("long")),
        "routes.txt": raw_routes(spark, sf),
        "trips.txt": raw_trips(spark, sf),
        "calendar_dates.txt": raw_calendar_dates(spark, sf),
    }
    return _issues(V.required_fields(tables))


@register(
    "coordinates",
    sql=f"""
    SELECT feed_id, 'error' AS severity, 'stops.txt' AS file_name, 'stop_lat' AS field, row_num AS row_index,
           CASE WHEN TRY_CAST(stop_lat AS DOUBLE) IS NULL THEN 'stop_lat ''' || stop_lat || ''' is not numeric'
                ELSE 'stop_lat ' || CAST(CAST(stop_lat AS DOUBLE) AS VARCHAR) || ' is outside [-90, 90]' END AS message
    FROM raw_stops
    WHERE stop_lat <> '' AND (TRY_CAST(stop_lat AS DOUBLE) IS NULL OR NOT CAST(stop_lat AS DOUBLE) BETWEEN -90 AND 90)
    UNION ALL
    SELECT feed_id, 'error', 'stops.txt', 'stop_lon', row_num,
           CASE WHEN TRY_CAST(stop_lon AS DOUBLE) IS NULL THEN 'stop_lon ''' || stop_lon || ''' is not numeric'
                ELSE 'stop_lon ' || CAST(CAST(stop_lon AS DOUBLE) AS VARCHAR) || ' is outside [-180, 180]' END
    FROM raw_stops
    WHERE stop_lon <> '' AND (TRY_CAST(stop_lon AS DOUBLE) IS NULL OR NOT CAST(stop_lon AS DOUBLE) BETWEEN -180 AND 180)
    """,
    extra_views=RAW_VIEWS,
)
def coordinates(spark, sf):
    return _issues(V.coordinates(raw_stops(spark, sf)))


@register(
    "route_metadata",
    sql=f"""
    SELECT feed_id, 'warning' AS severity, 'routes.txt' AS file_name, 'route_color' AS field, row_num AS row_index,
           'route_color ''' || route_color || ''' is not a 6-digit hex string' AS message
    FROM raw_routes WHERE coalesce(route_color, '') <> '' AND NOT regexp_full_match(route_color, '[0-9A-Fa-f]{{6}}')
    UNION ALL
    SELECT feed_id, 'error', 'routes.txt', 'route_type', row_num, 'route_type ''' || route_type || ''' is not an integer'
    FROM raw_routes WHERE route_type <> '' AND NOT regexp_full_match(trim(route_type), '[+-]?[0-9]+')
    UNION ALL
    SELECT feed_id, 'warning', 'routes.txt', 'route_type', row_num,
           'route_type ' || CAST(CAST(route_type AS INTEGER) AS VARCHAR) || ' is not a standard value'
    FROM raw_routes WHERE route_type <> '' AND regexp_full_match(trim(route_type), '[+-]?[0-9]+')
      AND TRY_CAST(route_type AS INTEGER) NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 11, 12)
    """,
    extra_views=RAW_VIEWS,
)
def route_metadata(spark, sf):
    return _issues(V.route_metadata(raw_routes(spark, sf)))


@register(
    "calendar_logic",
    sql=r"""
    WITH c AS (SELECT * FROM raw_calendar)
    SELECT feed_id, 'error' AS severity, 'calendar.txt' AS file_name, 'start_date' AS field, row_num AS row_index,
           'start_date ''' || start_date || ''' is not a valid YYYYMMDD date' AS message
    FROM c WHERE NOT (regexp_full_match(start_date, '\d{8}') AND substr(start_date, 1, 4) <> '0000'
                      AND try_strptime(start_date, '%Y%m%d') IS NOT NULL)
    UNION ALL
    SELECT feed_id, 'error', 'calendar.txt', 'end_date', row_num,
           'end_date ''' || end_date || ''' is not a valid YYYYMMDD date'
    FROM c WHERE NOT (regexp_full_match(end_date, '\d{8}') AND substr(end_date, 1, 4) <> '0000'
                      AND try_strptime(end_date, '%Y%m%d') IS NOT NULL)
    UNION ALL
    SELECT feed_id, 'error', 'calendar.txt', NULL, row_num,
           'start_date ''' || start_date || ''' is after end_date ''' || end_date || ''''
    FROM c WHERE regexp_full_match(start_date, '\d{8}') AND regexp_full_match(end_date, '\d{8}') AND start_date > end_date
    UNION ALL
    SELECT feed_id, 'error', 'calendar_dates.txt', 'date', row_num, 'date ''' || date || ''' is not a valid YYYYMMDD date'
    FROM raw_calendar_dates WHERE NOT (regexp_full_match(date, '\d{8}') AND substr(date, 1, 4) <> '0000'
                                       AND try_strptime(date, '%Y%m%d') IS NOT NULL)
    """,
    extra_views=RAW_VIEWS,
)
def calendar_logic(spark, sf):
    return _issues(V.date_logic(raw_calendar(spark, sf), raw_calendar_dates(spark, sf)))


@register(
    "time_format",
    sql="""
    SELECT feed_id, 'error' AS severity, 'stop_times.txt' AS file_name, 'arrival_time' AS field, trip_id, stop_sequence,
           'arrival_time ''' || arrival_time || ''' does not match HH:MM:SS' AS message
    FROM raw_stop_times WHERE arrival_time <> '' AND NOT regexp_full_match(arrival_time, '\\d{1,2}:\\d{2}:\\d{2}')
    UNION ALL
    SELECT feed_id, 'error', 'stop_times.txt', 'departure_time', trip_id, stop_sequence,
           'departure_time ''' || departure_time || ''' does not match HH:MM:SS'
    FROM raw_stop_times WHERE departure_time <> '' AND NOT regexp_full_match(departure_time, '\\d{1,2}:\\d{2}:\\d{2}')
    """,
    extra_views=RAW_VIEWS,
)
def time_format(spark, sf):
    frames = V.time_format(raw_stop_times(spark, sf), row_col=None, carry=["trip_id", "stop_sequence"])
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return u.select("feed_id", "severity", "file_name", "field", "trip_id", "stop_sequence", "message")


@register(
    "feed_reference_issues",
    sql="""
    SELECT feed_id, 'error' AS severity, 'trips.txt' AS file_name, 'route_id' AS field, row_num AS row_index,
           'route_id ''' || route_id || ''' not found in routes.txt' AS message
    FROM raw_trips t WHERE route_id <> '' AND NOT EXISTS (
        SELECT 1 FROM raw_routes r WHERE r.feed_id = t.feed_id AND r.route_id = t.route_id)
    UNION ALL
    SELECT feed_id, 'error', 'trips.txt', 'service_id', row_num,
           'service_id ''' || service_id || ''' not found in calendar(_dates).txt'
    FROM raw_trips t WHERE service_id <> '' AND NOT EXISTS (
        SELECT 1 FROM (SELECT feed_id, service_id FROM raw_calendar UNION SELECT feed_id, service_id FROM raw_calendar_dates) s
        WHERE s.feed_id = t.feed_id AND s.service_id = t.service_id)
    """,
    extra_views=RAW_VIEWS,
)
def feed_reference_issues(spark, sf):
    tables = {
        "trips.txt": raw_trips(spark, sf),
        "routes.txt": raw_routes(spark, sf),
        "calendar.txt": raw_calendar(spark, sf),
        "calendar_dates.txt": raw_calendar_dates(spark, sf),
    }
    return _issues(V.references(tables))


_DUPLICATES_SQL = """
    SELECT feed_id, 'error' AS severity, 'stop_times.txt' AS file_name, CAST(NULL AS VARCHAR) AS field, row_num AS row_index,
           'Duplicate primary key [''trip_id'', ''stop_sequence'']=[''' || trip_id || ''', ''' || stop_sequence
             || '''] (also at row ' || CAST(first_row AS VARCHAR) || ')' AS message
    FROM (SELECT *, min(row_num) OVER (PARTITION BY feed_id, trip_id, stop_sequence) AS first_row FROM raw_numbered_stop_times)
    WHERE row_num > first_row"""
_SEQUENCE_SQL = """
    SELECT feed_id, 'error' AS severity, 'stop_times.txt' AS file_name, 'stop_sequence' AS field, row_num AS row_index,
           'trip_id ''' || trip_id || ''' stop_sequence must strictly increase (saw ' || CAST(prev AS VARCHAR) || ' then '
             || stop_sequence || ')' AS message
    FROM (SELECT *, lag(CAST(stop_sequence AS BIGINT)) OVER (PARTITION BY feed_id, trip_id ORDER BY row_num) AS prev
          FROM raw_numbered_stop_times)
    WHERE CAST(stop_sequence AS BIGINT) <= prev"""


def _check_sql(table: str, file: str, field: str | None, where: str, message: str, severity: str = "error") -> str:
    """One check over a raw table. ``{q}`` in the message is a quoted cell: '<cell>'."""
    named = f"'{field}'" if field else "CAST(NULL AS VARCHAR)"
    return (f"SELECT feed_id, '{severity}' AS severity, '{file}' AS file_name, {named} AS field, row_num AS row_index, "
            f"{message} AS message FROM {table} x WHERE {where}")


def _quoted(c: str) -> str:
    return f"chr(39) || {c} || chr(39)"


def _all_issues_sql() -> str:
    """Every check of the validator over all files, written in SQL."""
    parts = [f"SELECT DISTINCT feed_id, 'error' AS severity, '{file}' AS file_name, '{c}' AS field, CAST(NULL AS BIGINT) AS row_index, "
             f"'Required field ''{c}'' missing from header' AS message FROM {table}"
             for file, table, names in (("agency.txt", "raw_agency", ["agency_url", "agency_timezone"]),
                                        ("calendar.txt", "raw_calendar", list(A.WEEKDAYS))) for c in names]
    parts.append(_check_sql("raw_routes", "routes.txt", "route_type", "route_type IS NULL OR trim(route_type) = ''",
                            "'Required field ''route_type'' is empty'"))
    for c, lo, hi in (("stop_lat", -90, 90), ("stop_lon", -180, 180)):
        number = f"regexp_full_match(trim({c}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"
        value = f"(CASE WHEN {number} THEN CAST({c} AS DOUBLE) END)"
        parts.append(_check_sql("raw_stops", "stops.txt", c, f"{c} <> '' AND NOT {number}", f"'{c} ' || {_quoted(c)} || ' is not numeric'"))
        parts.append(_check_sql("raw_stops", "stops.txt", c, f"{c} <> '' AND NOT {value} BETWEEN {lo} AND {hi}",
                                f"'{c} ' || CAST({value} AS VARCHAR) || ' is outside [{lo}, {hi}]'"))
    parts.append(_check_sql("raw_routes", "routes.txt", "route_color",
                            "coalesce(route_color, '') <> '' AND NOT regexp_full_match(route_color, '[0-9A-Fa-f]{6}')",
                            f"'route_color ' || {_quoted('route_color')} || ' is not a 6-digit hex string'", "warning"))
    whole = "regexp_full_match(trim(route_type), '[+-]?[0-9]+')"
    parts.append(_check_sql("raw_routes", "routes.txt", "route_type", f"route_type <> '' AND NOT {whole}",
                            f"'route_type ' || {_quoted('route_type')} || ' is not an integer'"))
    parts.append(_check_sql("raw_routes", "routes.txt", "route_type",
                            f"{whole} AND TRY_CAST(route_type AS INTEGER) NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 11, 12)",
                            "'route_type ' || trim(route_type) || ' is not a standard value'", "warning"))
    for c in ("arrival_time", "departure_time"):
        parts.append(_check_sql("raw_numbered_stop_times", "stop_times.txt", c,
                                f"{c} <> '' AND NOT regexp_full_match({c}, '[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}')",
                                f"'{c} ' || {_quoted(c)} || ' does not match HH:MM:SS'"))
    eight = "regexp_full_match({c}, '[0-9]{{8}}')"
    for c, file, table in (("start_date", "calendar.txt", "raw_calendar"), ("end_date", "calendar.txt", "raw_calendar"),
                           ("date", "calendar_dates.txt", "raw_calendar_dates")):
        real = f"({eight.format(c=c)} AND substr({c}, 1, 4) <> '0000' AND try_strptime({c}, '%Y%m%d') IS NOT NULL)"
        parts.append(_check_sql(table, file, c, f"{c} <> '' AND NOT {real}", f"'{c} ' || {_quoted(c)} || ' is not a valid YYYYMMDD date'"))
    parts.append(_check_sql("raw_calendar", "calendar.txt", None,
                            f"{eight.format(c='start_date')} AND {eight.format(c='end_date')} AND start_date > end_date",
                            f"'start_date ' || {_quoted('start_date')} || ' is after end_date ' || {_quoted('end_date')}"))
    for c, file, table, parents, where in (
            ("route_id", "trips.txt", "raw_trips", "SELECT feed_id, route_id AS k FROM raw_routes", "routes.txt"),
            ("service_id", "trips.txt", "raw_trips", "SELECT feed_id, service_id AS k FROM raw_calendar UNION "
             "SELECT feed_id, service_id AS k FROM raw_calendar_dates", "calendar(_dates).txt"),
            ("trip_id", "stop_times.txt", "raw_numbered_stop_times", "SELECT feed_id, trip_id AS k FROM raw_trips", "trips.txt"),
            ("stop_id", "stop_times.txt", "raw_numbered_stop_times", "SELECT feed_id, stop_id AS k FROM raw_stops", "stops.txt")):
        parts.append(_check_sql(table, file, c, f"{c} <> '' AND NOT EXISTS (SELECT 1 FROM ({parents}) p WHERE p.feed_id = x.feed_id AND p.k = x.{c})",
                                f"'{c} ' || {_quoted(c)} || ' not found in {where}'"))
    return "\n UNION ALL ".join([*parts, _DUPLICATES_SQL.strip(), _SEQUENCE_SQL.strip()])


@register("validator_duplicate_keys", sql=_DUPLICATES_SQL, extra_views=RAW_VIEWS)
def validator_duplicate_keys(spark, sf):
    """VAL-03 over all files of the feed."""
    return _issues(V.duplicate_primary_keys(raw_feed(spark, sf)))


@register("validator_stop_sequence", sql=_SEQUENCE_SQL, extra_views=RAW_VIEWS)
def validator_stop_sequence(spark, sf):
    """VAL-09 over every stop_time."""
    return _issues(V.stop_sequence_order(raw_numbered_stop_times(spark, sf)))


_MEMBER_VIEW = {"members": """
    SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS feed_id,
           ['agency', 'stops', 'routes', 'trips', 'stop_times', 'calendar', 'calendar_dates', 'shapes']
             [CAST(o_orderkey % 8 AS INTEGER) + 1] || '.txt' AS file_name
    FROM orders"""}


@register(
    "required_files",
    sql="""
    WITH f AS (SELECT DISTINCT feed_id FROM members)
    SELECT feed_id, 'error' AS severity, r AS file_name, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS row_index,
           'Required file ''' || r || ''' missing from feed' AS message
    FROM f, (VALUES ('agency.txt'), ('stops.txt'), ('routes.txt'), ('trips.txt'), ('stop_times.txt')) v(r)
    WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.feed_id = f.feed_id AND m.file_name = r)
    UNION ALL
    SELECT feed_id, 'error', 'calendar.txt', NULL, NULL, 'Either calendar.txt or calendar_dates.txt is required'
    FROM f WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.feed_id = f.feed_id
                             AND m.file_name IN ('calendar.txt', 'calendar_dates.txt'))
    """,
    extra_views=_MEMBER_VIEW,
)
def required_files(spark, sf):
    """VAL-01: every customer is a feed whose orders name the files of its archive."""
    names = F.array(*[F.lit(f"{t}.txt") for t in ("agency", "stops", "routes", "trips", "stop_times", "calendar",
                                                  "calendar_dates", "shapes")])
    present = A.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("feed_id"),
        F.element_at(names, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("file_name")).distinct()
    return V.required_files(present)


@register("validate_feed_issues", sql=_all_issues_sql(), extra_views=RAW_VIEWS)
def validate_feed_issues(spark, sf):
    """SO-05: every issue of every check over all files and all their columns."""
    return V.validate_feed(raw_feed(spark, sf)).select(*V.ISSUE_COLS)


@register(
    "issue_summary",
    sql=f"""
    WITH i AS ({_all_issues_sql()})
    SELECT feed_id, count(*) FILTER (WHERE severity = 'error') AS error_count,
           count(*) FILTER (WHERE severity = 'warning') AS warning_count,
           count(*) FILTER (WHERE severity NOT IN ('error', 'warning')) AS info_count,
           count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid,
           CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'draft'
                WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'warnings' ELSE 'certified' END AS quality_tag
    FROM i GROUP BY feed_id
    """,
    extra_views=RAW_VIEWS,
)
def issue_summary(spark, sf):
    """AG-13 over all checks, the required files included."""
    tables = raw_feed(spark, sf)
    present = V.union_issues([df.select("feed_id", F.lit(t).alias("file_name")).distinct() for t, df in tables.items()])
    return V.issue_summary(V.validate_feed(tables).unionByName(V.required_files(present)))


# --- row validation (PRJ-03/05/06/07) -------------------------------------------------
_FARES = ["single_ticket", "monthly_pass", "student", "senior", "social", "free", "other", "N/A"]


def passenger_upload(spark, sf):
    """events as a Transported Passengers upload, every cell text (as read from CSV)."""
    e = A.table(spark, sf, "events")
    et = F.col("event_type")
    res = (F.when(et == "view", "15min").when(et == "click", "hourly").when(et == "purchase", "daily")
           .when(et == "signup", "weekly").otherwise("minutely"))
    fares = F.array(*[F.lit(x) for x in _FARES])
    return e.select(
        F.lit(A.FEED_ID).alias("feed_id"),
        F.col("event_id").alias("row_num"),
        F.col("ts").cast("string").alias("timestamp"),
        et.alias("line_id"),
        F.col("user_id").cast("string").alias("stop_id"),
        (F.col("event_id") % 3).cast("string").alias("direction_id"),
        res.alias("temporal_resolution"),
        F.col("value").cast("string").alias("number_of_validations"),
        F.col("user_id").cast("string").alias("number_of_users"),
        (F.col("user_id") % 7).cast("string").alias("boarding_count"),
        (F.col("user_id") % 5 - 1).cast("string").alias("alighting_count"),
        F.col("value").cast("string").alias("passenger_km_index"),
        F.element_at(fares, (F.col("user_id") % 8 + 1).cast("int")).alias("fare_category"),
    )


_PASSENGER_UPLOAD_SQL = {"passenger_upload": """
    SELECT 'F1' AS feed_id, event_id AS row_num, CAST(ts AS VARCHAR) AS timestamp, event_type AS line_id,
           CAST(user_id AS VARCHAR) AS stop_id, CAST(event_id % 3 AS VARCHAR) AS direction_id,
           CASE event_type WHEN 'view' THEN '15min' WHEN 'click' THEN 'hourly' WHEN 'purchase' THEN 'daily'
                WHEN 'signup' THEN 'weekly' ELSE 'minutely' END AS temporal_resolution,
           CAST(value AS VARCHAR) AS number_of_validations, CAST(user_id AS VARCHAR) AS number_of_users,
           CAST(user_id % 7 AS VARCHAR) AS boarding_count, CAST(user_id % 5 - 1 AS VARCHAR) AS alighting_count,
           CAST(value AS VARCHAR) AS passenger_km_index,
           ['single_ticket', 'monthly_pass', 'student', 'senior', 'social', 'free', 'other', 'N/A'][user_id % 8 + 1]
             AS fare_category
    FROM events"""}


@register(
    "validate_rows_good",
    sql="""
    SELECT feed_id, row_num, CAST(CAST(timestamp AS TIMESTAMP) AS VARCHAR) AS ts_text, line_id, stop_id,
           CAST(direction_id AS BIGINT) AS direction_id, temporal_resolution,
           CAST(CAST(number_of_validations AS DOUBLE) AS BIGINT) AS number_of_validations,
           CAST(number_of_users AS BIGINT) AS number_of_users, CAST(boarding_count AS BIGINT) AS boarding_count,
           CAST(alighting_count AS BIGINT) AS alighting_count, CAST(passenger_km_index AS DOUBLE) AS passenger_km_index,
           fare_category
    FROM passenger_upload
    WHERE CAST(direction_id AS INTEGER) <= 1
      AND temporal_resolution IN ('15min', '30min', 'hourly', 'daily', 'weekly', 'monthly')
      AND CAST(number_of_validations AS DOUBLE) = floor(CAST(number_of_validations AS DOUBLE))
      AND CAST(alighting_count AS INTEGER) >= 0
      AND lower(fare_category) NOT IN ('n/a', 'nan', '', 'null')
    """,
    extra_views=_PASSENGER_UPLOAD_SQL,
)
def validate_rows_good(spark, sf):
    good, _ = schemas.UPLOADS["Transported Passengers"].validate(passenger_upload(spark, sf), keep=["feed_id"])
    return good.select(
        "feed_id", "row_num", F.col("timestamp").cast("string").alias("ts_text"), "line_id", "stop_id", "direction_id",
        "temporal_resolution", "number_of_validations", "number_of_users", "boarding_count", "alighting_count",
        "passenger_km_index", "fare_category",
    )


@register(
    "validate_rows_errors",
    sql="""
    SELECT feed_id, row_num, row_num + 2 AS line, concat_ws('; ',
        CASE WHEN CAST(direction_id AS INTEGER) > 1 THEN 'direction_id: Input should be less than or equal to 1' END,
        CASE WHEN temporal_resolution NOT IN ('15min', '30min', 'hourly', 'daily', 'weekly', 'monthly') THEN
          'temporal_resolution: Input should be ''15min'', ''30min'', ''hourly'', ''daily'', ''weekly'' or ''monthly''' END,
        CASE WHEN CAST(number_of_validations AS DOUBLE) <> floor(CAST(number_of_validations AS DOUBLE)) THEN
          'number_of_validations: Input should be a valid integer' END,
        CASE WHEN CAST(alighting_count AS INTEGER) < 0 THEN 'alighting_count: Input should be greater than or equal to 0' END,
        CASE WHEN lower(fare_category) IN ('n/a', 'nan', '', 'null') THEN 'fare_category: Field required' END) AS message
    FROM passenger_upload
    WHERE CAST(direction_id AS INTEGER) > 1
      OR temporal_resolution NOT IN ('15min', '30min', 'hourly', 'daily', 'weekly', 'monthly')
      OR CAST(number_of_validations AS DOUBLE) <> floor(CAST(number_of_validations AS DOUBLE))
      OR CAST(alighting_count AS INTEGER) < 0
      OR lower(fare_category) IN ('n/a', 'nan', '', 'null')
    """,
    extra_views=_PASSENGER_UPLOAD_SQL,
)
def validate_rows_errors(spark, sf):
    _, bad = schemas.UPLOADS["Transported Passengers"].validate(passenger_upload(spark, sf), keep=["feed_id"])
    return bad


def stop_upload(spark, sf):
    """part as a Stop Spatial Features upload, every cell text."""
    p = A.table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    lat = F.when(k % 101 == 0, F.lit("999")).when(k % 103 == 0, F.lit("abc")).otherwise(((k * 7919 % 180) - 90).cast("string"))
    lon = ((k * 104729 % 360) - 180 + F.when(size > 45, 200).otherwise(0)).cast("string")
    zone = F.element_at(F.array(*[F.lit(z) for z in ("urban", "suburban", "rural", "downtown")]), (size % 4 + 1).cast("int"))
    return p.select(
        F.lit(A.FEED_ID).alias("feed_id"), k.alias("row_num"), k.cast("string").alias("stop_id"),
        F.col("p_name").alias("stop_name"), lat.alias("latitude"), lon.alias("longitude"),
        F.col("p_brand").alias("zone_id"), zone.alias("zone_type"),
        (F.col("p_retailprice") - 1000).cast("string").alias("population_density"),
        (size % 5).cast("string").alias("num_lines_served"),
        F.when(size % 2 == 0, "yes").otherwise("no").alias("is_terminal"),
    )


_STOP_UPLOAD_SQL = {"stop_upload": """
    SELECT 'F1' AS feed_id, p_partkey AS row_num, CAST(p_partkey AS VARCHAR) AS stop_id, p_name AS stop_name,
           CASE WHEN p_partkey % 101 = 0 THEN '999' WHEN p_partkey % 103 = 0 THEN 'abc'
                ELSE CAST((p_partkey * 7919 % 180) - 90 AS VARCHAR) END AS latitude,
           CAST((p_partkey * 104729 % 360) - 180 + CASE WHEN p_size > 45 THEN 200 ELSE 0 END AS VARCHAR) AS longitude,
           p_brand AS zone_id, ['urban', 'suburban', 'rural', 'downtown'][p_size % 4 + 1] AS zone_type,
           CAST(p_retailprice - 1000 AS VARCHAR) AS population_density, CAST(p_size % 5 AS VARCHAR) AS num_lines_served,
           CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS is_terminal
    FROM part"""}

RELAXED_MANDATORY = ["stop_id", "latitude"]


@register(
    "validate_relaxed",
    sql="""
    SELECT feed_id, row_num, stop_id, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude,
           zone_type, round(CAST(population_density AS DOUBLE), 6) AS population_density,
           CAST(num_lines_served AS BIGINT) AS num_lines_served, is_terminal = 'yes' AS is_terminal
    FROM stop_upload
    WHERE TRY_CAST(latitude AS DOUBLE) BETWEEN -90 AND 90
    """,
    extra_views=_STOP_UPLOAD_SQL,
)
def validate_relaxed(spark, sf):
    schema = schemas.UPLOADS["Stop Spatial Features"].relaxed(RELAXED_MANDATORY)
    good, _ = schema.validate(stop_upload(spark, sf), keep=["feed_id"])
    return good.select("feed_id", "row_num", "stop_id", "latitude", "longitude", "zone_type",
                       F.round("population_density", 6).alias("population_density"), "num_lines_served", "is_terminal")


@register(
    "validate_relaxed_errors",
    sql="""
    SELECT feed_id, row_num, row_num + 2 AS line,
           CASE WHEN TRY_CAST(latitude AS DOUBLE) IS NULL THEN 'latitude: Input should be a valid number'
                ELSE 'latitude: Input should be less than or equal to 90' END AS message
    FROM stop_upload WHERE NOT coalesce(TRY_CAST(latitude AS DOUBLE) BETWEEN -90 AND 90, false)
    """,
    extra_views=_STOP_UPLOAD_SQL,
)
def validate_relaxed_errors(spark, sf):
    schema = schemas.UPLOADS["Stop Spatial Features"].relaxed(RELAXED_MANDATORY)
    _, bad = schema.validate(stop_upload(spark, sf), keep=["feed_id"])
    return bad


@register(
    "clean_null_tokens",
    sql=r"""
    WITH t AS (SELECT conv_id, turn, nullif(regexp_replace(role, '^\s+|\s+$', '', 'g'), '') AS role,
                      nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS text FROM conversations)
    SELECT conv_id, turn,
           CASE WHEN lower(role) IN ('n/a', 'nan', '', 'null') THEN NULL ELSE role END AS role,
           CASE WHEN lower(text) IN ('n/a', 'nan', '', 'null') THEN NULL ELSE text END AS text,
           CAST(length(CASE WHEN lower(text) IN ('n/a', 'nan', '', 'null') THEN NULL ELSE text END) AS BIGINT) AS n_chars
    FROM t
    """,
)
def clean_null_tokens(spark, sf):
    """SRC-04 cell normaliser (strip, empty to NULL) then PRJ-03 null tokens."""
    c = A.table(spark, sf, "conversations")

    def cell(x):
        stripped = S.strip(x)
        return S.null_token(F.when(stripped == "", F.lit(None)).otherwise(stripped))

    return c.select("conv_id", "turn", cell("role").alias("role"), cell("text").alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))


@register(
    "validation_report",
    sql="""
    SELECT 'transported_passengers' AS dataset, count(*) AS total,
           count(*) FILTER (WHERE CAST(direction_id AS INTEGER) <= 1
             AND temporal_resolution IN ('15min', '30min', 'hourly', 'daily', 'weekly', 'monthly')
             AND CAST(number_of_validations AS DOUBLE) = floor(CAST(number_of_validations AS DOUBLE))
             AND CAST(alighting_count AS INTEGER) >= 0 AND lower(fare_category) NOT IN ('n/a', 'nan', '', 'null')) AS valid,
           count(*) FILTER (WHERE NOT (CAST(direction_id AS INTEGER) <= 1
             AND temporal_resolution IN ('15min', '30min', 'hourly', 'daily', 'weekly', 'monthly')
             AND CAST(number_of_validations AS DOUBLE) = floor(CAST(number_of_validations AS DOUBLE))
             AND CAST(alighting_count AS INTEGER) >= 0 AND lower(fare_category) NOT IN ('n/a', 'nan', '', 'null'))) AS invalid
    FROM passenger_upload
    """,
    extra_views=_PASSENGER_UPLOAD_SQL,
)
def validation_report(spark, sf):
    """AG-03 / SNK-04 content: total, valid and invalid rows of an upload."""
    from railyard.sinks import layers

    good, bad = schemas.UPLOADS["Transported Passengers"].validate(passenger_upload(spark, sf), keep=["feed_id"])
    return layers.validation_report(good, bad, "transported_passengers")
