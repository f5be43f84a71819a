"""Demand feature builds (Mode A / Mode B) and network topology (JN-01..03, SC-13/14, AG-24).

One output row per passenger row (demand is not aggregated). Weather comes
from the forward as-of join, holidays from an equi-join on the day, stop
attributes from an equi-join on the validated, de-duplicated node table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard import schemas
from railyard.functions import scalars as S
from railyard.operators import joins, ordered

FEED = "feed_id"


def holiday_dates(calendar_events: DataFrame) -> DataFrame:
    """JN-02: distinct (feed, date) of events typed exactly 'holiday'."""
    return (calendar_events.where(F.col("event_type") == "holiday")
            .select(FEED, F.to_date("event_date").alias("_hday")).distinct())


def with_holiday(df: DataFrame, ts: str, calendar_events: DataFrame | None) -> DataFrame:
    if calendar_events is None:
        return df.withColumn("_is_holiday", F.lit(False))
    h = holiday_dates(calendar_events).withColumn("_h", F.lit(True))
    out = df.withColumn("_hday", F.to_date(ts)).join(h, [FEED, "_hday"], "left")
    return out.withColumn("_is_holiday", F.coalesce("_h", F.lit(False))).drop("_h", "_hday")


def with_weather(df: DataFrame, ts: str, weather: DataFrame | None) -> DataFrame:
    if weather is None:
        return df.withColumn("temperature_celsius", F.lit(None).cast("double")).withColumn(
            "precipitation_mm", F.lit(None).cast("double"))
    w = weather.select(FEED, F.col("timestamp").alias("_wts"), "temperature_celsius", "precipitation_mm")
    return joins.as_of_forward(df, w, ts, ["temperature_celsius", "precipitation_mm"], right_ts="_wts")


def demand(validations: str = "number_of_validations"):
    """Integer part of the validations; NULL (or NaN) counts as 0."""
    return F.coalesce(S.safe_int(F.col(validations)), F.lit(0)).alias("demand")


def mode_a_samples(passengers: DataFrame, weather: DataFrame | None = None,
                   calendar_events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """TimeSeriesDemandSample rows (good, errors) — one per passenger row."""
    # weather first: the as-of join reads its left side twice (rows and day
    # span), so it should see the plain scan, not the results of other joins
    p = with_weather(passengers, "timestamp", weather)
    p = with_holiday(p, "timestamp", calendar_events)
    res = F.col("temporal_resolution") if "temporal_resolution" in passengers.columns else F.lit("daily")
    samples = p.select(
        FEED, "row_num", F.col("timestamp"), F.col("line_id").cast("string").alias("line_id"), demand(),
        F.coalesce(res, F.lit("daily")).alias("temporal_resolution"),
        *S.temporal_features("timestamp", "_is_holiday"),
        F.lit(None).cast("double").alias("avg_frequency"), F.lit(None).cast("long").alias("total_capacity"),
        "temperature_celsius", "precipitation_mm",
    )
    return schemas.GOLD["TimeSeriesDemandSample"].validate(samples, keep=[FEED])


def stop_nodes(stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated StopSpatialFeatures nodes, last valid row per stop_id (WN-05)."""
    good, bad = schemas.UPLOADS["Stop Spatial Features"].validate(stops, keep=[FEED])
    last = ordered.first_per_key(good, [FEED, "stop_id"], ["row_num"], last=True)
    return last, bad


def mode_b_samples(passengers: DataFrame, stops: DataFrame, weather: DataFrame | None = None,
                   calendar_events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SpatioTemporalDemandSample rows; passengers at unknown stops are dropped (JN-03)."""
    nodes, _ = stop_nodes(stops)
    node_cols = nodes.select(FEED, F.col("stop_id").alias("_node"), "latitude", "longitude", "zone_type",
                             "population_density", "num_lines_served", "is_terminal", "is_interchange")
    p = with_weather(passengers, "timestamp", weather)
    p = p.withColumn("_node", F.col("stop_id").cast("string"))
    p = p.join(node_cols, [FEED, "_node"], "inner")
    p = with_holiday(p, "timestamp", calendar_events)
    res = F.col("temporal_resolution") if "temporal_resolution" in passengers.columns else F.lit("daily")
    feats = S.temporal_features("timestamp", "_is_holiday", day_of_month=False)
    samples = p.select(
        FEED, "row_num", "timestamp", F.col("_node").alias("node_id"), F.col("line_id").cast("string").alias("line_id"),
        "latitude", "longitude", demand(),
        (F.col("boarding_count") if "boarding_count" in p.columns else F.lit(None)).cast("long").alias("boarding_count"),
        (F.col("alighting_count") if "alighting_count" in p.columns else F.lit(None)).cast("long").alias("alighting_count"),
        F.coalesce(res, F.lit("daily")).alias("temporal_resolution"),
        *feats,
        "zone_type", "population_density", "num_lines_served", "is_terminal", "is_interchange",
        F.lit(None).cast("double").alias("avg_frequency"), "temperature_celsius", "precipitation_mm",
    )
    return schemas.GOLD["SpatioTemporalDemandSample"].validate(samples, keep=[FEED])


def topology_summary(stops: DataFrame, connections: DataFrame) -> DataFrame:
    """AG-24: valid node / edge counts per feed (plus the invalid ones)."""
    nodes, bad_nodes = stop_nodes(stops)
    edges, bad_edges = schemas.UPLOADS["Stop Connections"].validate(connections, keep=[FEED])

    def cnt(df, name):
        return df.groupBy(FEED).agg(F.count(F.lit(1)).alias(name))

    out = cnt(nodes, "num_nodes")
    for df, name in ((edges, "num_edges"), (bad_nodes, "invalid_nodes"), (bad_edges, "invalid_edges")):
        out = out.join(cnt(df, name), FEED, "full")
    return out.select(FEED, *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                              for c in ("num_nodes", "num_edges", "invalid_nodes", "invalid_edges")],
                      F.lit("EPSG:4326").alias("crs"))


def topology(stops: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK-08 network topology as (nodes, edges, summary) datasets.

    Written as three partitioned datasets rather than one nested document
    per feed, so no feed's graph is ever gathered into a single row."""
    nodes, _ = stop_nodes(stops)
    edges, _ = schemas.UPLOADS["Stop Connections"].validate(connections, keep=[FEED])
    return nodes, edges, topology_summary(stops, connections)
