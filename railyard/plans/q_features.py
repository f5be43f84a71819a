"""Feature-build queries: as-of weather, temporal features, Mode A/B samples, topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.functions import scalars as S
from railyard.operators import features as FE
from railyard.plans import adapters as A
from railyard.plans.registry import register

_LAST_WEATHER = """
    lw AS (SELECT feed_id, arg_max(temperature_celsius, timestamp) AS lt, arg_max(precipitation_mm, timestamp) AS lp
           FROM a_weather GROUP BY feed_id),
    aw AS (SELECT p.*, w.timestamp AS wts, w.temperature_celsius AS wt, w.precipitation_mm AS wp
           FROM a_passengers p ASOF LEFT JOIN a_weather w ON p.feed_id = w.feed_id AND p.timestamp <= w.timestamp),
    pw AS (SELECT aw.*, CASE WHEN wts IS NULL THEN lt ELSE wt END AS temperature_celsius,
                  CASE WHEN wts IS NULL THEN lp ELSE wp END AS precipitation_mm
           FROM aw LEFT JOIN lw ON lw.feed_id = aw.feed_id)"""

_TEMPORAL = """
    CASE WHEN hour(timestamp) = 0 AND minute(timestamp) = 0 THEN NULL ELSE hour(timestamp) END AS hour_of_day,
    isodow(timestamp) - 1 AS day_of_week, {dom}month(timestamp) AS month, year(timestamp) AS year,
    isodow(timestamp) >= 6 AS is_weekend, is_holiday,
    CASE WHEN is_holiday OR isodow(timestamp) = 7 THEN 'sunday_holiday' WHEN isodow(timestamp) = 6 THEN 'saturday'
         ELSE 'weekday' END AS day_type,
    CASE WHEN month(timestamp) IN (3, 4, 5) THEN 'spring' WHEN month(timestamp) IN (6, 7, 8) THEN 'summer'
         WHEN month(timestamp) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season"""

_HOLIDAY = "EXISTS (SELECT 1 FROM a_holidays h WHERE h.feed_id = x.feed_id AND h.event_date = CAST(x.timestamp AS DATE))"


@register(
    "as_of_weather",
    sql=f"""
    WITH {_LAST_WEATHER}
    SELECT feed_id, row_num, round(temperature_celsius, 6) AS temperature_celsius,
           round(precipitation_mm, 6) AS precipitation_mm
    FROM pw
    """,
)
def as_of_weather(spark, sf):
    """JN-01: first observation at or after each passenger row, else the last one."""
    p = A.a_passengers(spark, sf).select("feed_id", "row_num", "timestamp")
    out = FE.with_weather(p, "timestamp", A.a_weather(spark, sf))
    return out.select("feed_id", "row_num", F.round("temperature_celsius", 6).alias("temperature_celsius"),
                      F.round("precipitation_mm", 6).alias("precipitation_mm"))


@register(
    "temporal_features",
    sql=f"""
    WITH x0 AS (SELECT * FROM a_passengers), x AS (SELECT x0.*, {_HOLIDAY.replace('x.', 'x0.')} AS is_holiday FROM x0)
    SELECT feed_id, row_num, {_TEMPORAL.format(dom='day(timestamp) AS day_of_month, ')}
    FROM x
    """,
)
def temporal_features(spark, sf):
    """SC-13/14 + JN-02 on every event."""
    p = FE.with_holiday(A.a_passengers(spark, sf), "timestamp", A.a_holidays(spark, sf))
    out = p.select("feed_id", "row_num", *S.temporal_features("timestamp", "_is_holiday"))
    return out.select(*[F.col(c).cast("long").alias(c) if c in ("hour_of_day", "day_of_week", "day_of_month", "month",
                                                                  "year") else c for c in out.columns])


@register(
    "mode_a_samples",
    sql=f"""
    WITH {_LAST_WEATHER},
    x AS (SELECT pw.*, EXISTS (SELECT 1 FROM a_holidays h WHERE h.feed_id = pw.feed_id
                                AND h.event_date = CAST(pw.timestamp AS DATE)) AS is_holiday FROM pw)
    SELECT feed_id, row_num, line_id, CAST(coalesce(trunc(number_of_validations), 0) AS BIGINT) AS demand,
           'daily' AS temporal_resolution, {_TEMPORAL.format(dom='day(timestamp) AS day_of_month, ')},
           round(temperature_celsius, 6) AS temperature_celsius, round(precipitation_mm, 6) AS precipitation_mm
    FROM x
    """,
)
def mode_a_samples(spark, sf):
    good, _ = FE.mode_a_samples(A.a_passengers(spark, sf), A.a_weather(spark, sf), A.a_holidays(spark, sf))
    return good.select(
        "feed_id", "row_num", "line_id", "demand", "temporal_resolution", "hour_of_day", "day_of_week", "day_of_month",
        "month", "year", "is_weekend", "is_holiday", "day_type", "season",
        F.round("temperature_celsius", 6).alias("temperature_celsius"),
        F.round("precipitation_mm", 6).alias("precipitation_mm"))


def stop_features(spark, sf):
    """Network nodes: every part as a stop with spatial attributes; the stops of
    small parts have keys that no passenger row names (a seeded fault)."""
    p = A.table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    node = F.when(size > 10, k).otherwise(-k)
    zones = F.array(F.lit("urban"), F.lit("suburban"), F.lit("rural"))
    return p.select(
        F.lit(A.FEED_ID).alias("feed_id"), k.alias("row_num"), node.cast("string").alias("stop_id"),
        F.col("p_name").alias("stop_name"), ((k * 7919 % 180) - 90).cast("double").alias("latitude"),
        ((k * 104729 % 360) - 180).cast("double").alias("longitude"), F.col("p_brand").alias("zone_id"),
        F.element_at(zones, (size % 3 + 1).cast("int")).alias("zone_type"),
        F.col("p_retailprice").alias("population_density"), (size % 5 + 1).alias("num_lines_served"),
        (size % 2 == 0).alias("is_terminal"), (size % 3 == 0).alias("is_interchange"))


_STOP_FEATURES_SQL = """
    SELECT 'F1' AS feed_id, CAST(CASE WHEN p_size > 10 THEN p_partkey ELSE -p_partkey END AS VARCHAR) AS node_id,
           CAST((p_partkey * 7919 % 180) - 90 AS DOUBLE) AS latitude,
           CAST((p_partkey * 104729 % 360) - 180 AS DOUBLE) AS longitude,
           ['urban', 'suburban', 'rural'][p_size % 3 + 1] AS zone_type, p_retailprice AS population_density,
           CAST(p_size % 5 + 1 AS BIGINT) AS num_lines_served, p_size % 2 = 0 AS is_terminal,
           p_size % 3 = 0 AS is_interchange
    FROM part"""


@register(
    "mode_b_samples",
    sql=f"""
    WITH {_LAST_WEATHER},
    n AS ({_STOP_FEATURES_SQL}),
    x AS (SELECT pw.*, n.*, EXISTS (SELECT 1 FROM a_holidays h WHERE h.feed_id = pw.feed_id
                                     AND h.event_date = CAST(pw.timestamp AS DATE)) AS is_holiday
          FROM pw JOIN n ON n.feed_id = pw.feed_id AND n.node_id = CAST(pw.stop_id AS VARCHAR))
    SELECT feed_id, row_num, node_id, line_id, latitude, longitude,
           CAST(coalesce(trunc(number_of_validations), 0) AS BIGINT) AS demand,
           {_TEMPORAL.format(dom='')},
           zone_type, round(population_density, 6) AS population_density, num_lines_served, is_terminal,
           is_interchange, round(temperature_celsius, 6) AS temperature_celsius,
           round(precipitation_mm, 6) AS precipitation_mm
    FROM x
    """,
)
def mode_b_samples(spark, sf):
    good, _ = FE.mode_b_samples(A.a_passengers(spark, sf), stop_features(spark, sf), A.a_weather(spark, sf),
                                A.a_holidays(spark, sf))
    return good.select(
        "feed_id", "row_num", "node_id", "line_id", "latitude", "longitude", "demand", "hour_of_day", "day_of_week",
        "month", "year", "is_weekend", "is_holiday", "day_type", "season", "zone_type",
        F.round("population_density", 6).alias("population_density"), "num_lines_served", "is_terminal",
        "is_interchange", F.round("temperature_celsius", 6).alias("temperature_celsius"),
        F.round("precipitation_mm", 6).alias("precipitation_mm"))


def stop_connections(spark, sf):
    """orders as graph edges: customer to next customer on the order's priority line."""
    o = A.table(spark, sf, "orders")
    return o.select(
        F.lit(A.FEED_ID).alias("feed_id"), F.col("o_orderkey").alias("row_num"),
        F.col("o_custkey").cast("string").alias("source_stop_id"),
        (F.col("o_custkey") + 1).cast("string").alias("target_stop_id"),
        F.col("o_orderpriority").alias("line_id"), (F.col("o_orderkey") % 2).alias("direction_id"),
        (F.col("o_orderkey") % 10).alias("sequence_order"), (F.col("o_totalprice") / 1000).alias("distance_km"),
        (F.col("o_totalprice") / 100).cast("long").alias("travel_time_seconds"))


@register(
    "topology_summary",
    sql="""
    SELECT 'F1' AS feed_id, (SELECT count(*) FROM part) AS num_nodes,
           (SELECT count(*) FROM orders WHERE o_orderkey % 10 >= 1) AS num_edges,
           CAST(0 AS BIGINT) AS invalid_nodes,
           (SELECT count(*) FROM orders WHERE o_orderkey % 10 < 1) AS invalid_edges,
           'EPSG:4326' AS crs
    """,
)
def topology_summary(spark, sf):
    """AG-24: valid nodes and edges (edges numbered 0 fail sequence_order >= 1)."""
    return FE.topology_summary(stop_features(spark, sf), stop_connections(spark, sf))
