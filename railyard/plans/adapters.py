"""Adapter views: the driver's TPC-H-like tables seen as transit tables.

Each adapter is a pure projection (no filters on ids, no caps), so the work of
every query grows with the tables. All adapters carry a ``feed_id`` column;
every row of one test directory belongs to one feed, which deliberately makes
``feed_id`` a hot key: no operator may partition by it alone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapter contract (FIXTURES.md §3).
FEED_ID = "F1"
CALENDAR_EPOCH = _dt.date(2024, 1, 1)
SERVICE_MODULUS = 110          # o_orderkey % 110; services 100..109 have no calendar row
SEGMENT_ROUTE_TYPE = {         # c_mktsegment -> route_type (FURNITURE 9 is not a mapped mode)
    "BUILDING": 3,
    "AUTOMOBILE": 11,
    "MACHINERY": 2,
    "HOUSEHOLD": 0,
    "FURNITURE": 9,
}
HOLIDAY_MIN_VALUE = 300.0
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _feed() -> Column:
    return F.lit(FEED_ID).alias("feed_id")


def _case_map(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


def a_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(_feed(), F.col("n_nationkey").alias("agency_id"), F.col("n_name").alias("agency_name"))


def a_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        _feed(),
        F.col("c_custkey").alias("route_id"),
        F.col("c_nationkey").alias("agency_id"),
        _case_map(F.col("c_mktsegment"), SEGMENT_ROUTE_TYPE).alias("route_type"),
        F.col("c_name").alias("route_short_name"),
        F.col("c_mktsegment").alias("route_long_name"),
    )


def a_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        _feed(),
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_custkey").alias("route_id"),
        (F.col("o_orderkey") % SERVICE_MODULUS).alias("service_id"),
        (F.col("o_orderkey") % 2).cast("int").alias("direction_id"),
        F.col("o_orderkey").alias("row_num"),
        F.col("o_orderstatus").alias("trip_status"),
    )


def stop_time_order_cols() -> list[str]:
    """Input order of a_stop_times: the table has no row number, this key is unique."""
    return ["l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def arrival_secs(orderkey: Column, linenumber: Column) -> Column:
    return (orderkey * 37 + linenumber * 600) % 100000


def a_stop_times(spark: SparkSession, sf_dir: str, pattern_stops: bool = False) -> DataFrame:
    """lineitem as stop_times; ``pattern_stops`` folds stop ids to 3 values (l_partkey % 3)."""
    li = table(spark, sf_dir, "lineitem")
    stop = (F.col("l_partkey") % 3) if pattern_stops else F.col("l_partkey")
    arr = arrival_secs(F.col("l_orderkey"), F.col("l_linenumber"))
    return li.select(
        _feed(),
        F.col("l_orderkey").alias("trip_id"),
        F.col("l_linenumber").alias("stop_sequence"),
        stop.alias("stop_id"),
        arr.alias("arrival_secs"),
        (arr + 60).alias("departure_secs"),
        F.col("l_quantity").alias("shape_dist_traveled"),
        *[F.col(c) for c in stop_time_order_cols()],
    )


def a_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    lat = (k * 7919 % 180) - 90
    lon = (k * 104729 % 360) - 180
    parent = (
        F.when(F.col("p_size") % 10 == 0, F.lit(-1).cast("bigint"))
        .when(F.col("p_size") % 2 == 0, k + 1)
    )
    lat_text = (
        F.when(k % 101 == 0, F.lit("999"))
        .when(k % 103 == 0, F.lit("abc"))
        .otherwise(lat.cast("string"))
    )
    return p.select(
        _feed(),
        k.alias("stop_id"),
        F.col("p_name").alias("stop_name"),
        F.col("p_brand").alias("zone_id"),
        (F.col("p_size") % 3).alias("location_type"),
        parent.alias("parent_station"),
        lat.cast("double").alias("stop_lat"),
        lon.cast("double").alias("stop_lon"),
        lat_text.alias("stop_lat_text"),
        lon.cast("string").alias("stop_lon_text"),
        F.col("p_size").alias("p_size"),
    )


def a_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    start = F.date_add(F.lit(CALENDAR_EPOCH), (F.col("s_suppkey") % 28).cast("int"))
    bits = [F.shiftright(F.col("s_suppkey"), i).bitwiseAND(1).cast("int").alias(d) for i, d in enumerate(WEEKDAYS)]
    return s.select(
        _feed(),
        F.col("s_suppkey").alias("service_id"),
        *bits,
        start.alias("start_date"),
        F.date_add(start, 30).alias("end_date"),
    )


def a_calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    start = F.date_add(F.lit(CALENDAR_EPOCH), (F.col("s_suppkey") % 28).cast("int"))
    return s.select(
        _feed(),
        F.col("s_suppkey").alias("service_id"),
        F.date_add(start, 3).alias("date"),
        (1 + F.col("s_suppkey") % 2).cast("int").alias("exception_type"),
    )


def a_passengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        _feed(),
        F.col("event_id").alias("row_num"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("line_id"),
        F.col("user_id").alias("stop_id"),
        F.col("value").alias("number_of_validations"),
    )


def a_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type") == "purchase").select(
        _feed(),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("temperature_celsius"),
        (F.col("value") / 10).alias("precipitation_mm"),
    )


def a_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holiday calendar events: days with a sign-up event worth at least 300."""
    e = table(spark, sf_dir, "events")
    return (
        e.where((F.col("event_type") == "signup") & (F.col("value") >= HOLIDAY_MIN_VALUE))
        .select(_feed(), F.to_date("ts").alias("event_date"), F.lit("holiday").alias("event_type"))
        .distinct()
    )
