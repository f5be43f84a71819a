"""Silver → GTFS mapping (PRJ-16/17, WN-02..04, JN-04..06, AG-09, AG-14).

Input frames carry ``feed_id`` and an input-order key (``order_cols``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.functions import scalars as S
from railyard.operators import joins, ordered

FEED = "feed_id"
# fixed values: defaults the mapper writes
DEFAULT_SERVICE_ID = "WEEKDAY"
DEFAULT_ROUTE_TYPE = 3
DEFAULT_TRAVEL_SECS = 120
DEFAULT_AGENCY_URL = "https://example.com"
DEFAULT_AGENCY_TIMEZONE = "America/Sao_Paulo"
REMOVE_EVENTS = ("holiday", "strike")
ADD_EVENTS = ("special_event",)


def map_stops(stop_features: DataFrame) -> DataFrame:
    """PRJ-16: terminals become stations (location_type 1), the rest stops."""
    return stop_features.select(
        FEED, F.col("stop_id").cast("string").alias("stop_id"), "stop_name",
        F.col("latitude").alias("stop_lat"), F.col("longitude").alias("stop_lon"), "zone_id",
        F.when(F.coalesce(F.col("is_terminal"), F.lit(False)), 1).otherwise(0).alias("location_type"))


def map_transfers(connections: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """WN-02: first connection per (source, target); timed ones are type 2."""
    c = connections.select(FEED, F.col("source_stop_id").cast("string").alias("from_stop_id"),
                           F.col("target_stop_id").cast("string").alias("to_stop_id"),
                           F.col("travel_time_seconds").alias("tt"), *order_cols)
    first = ordered.first_per_key(c, [FEED, "from_stop_id", "to_stop_id"], list(order_cols))
    tt = F.col("tt")
    return first.select(FEED, "from_stop_id", "to_stop_id",
                        F.when(tt.isNotNull() & (tt.cast("long") > 0), 2).otherwise(0).alias("transfer_type"),
                        tt.cast("long").alias("min_transfer_time"))


def map_calendar_dates(events: DataFrame, service_id: str = DEFAULT_SERVICE_ID) -> DataFrame:
    """PRJ-17: holiday/strike remove (2), special_event adds (1), others remove; bad dates dropped."""
    et = F.lower(S.strip(F.coalesce(F.col("event_type").cast("string"), F.lit(""))))
    exc = F.when(et.isin(*REMOVE_EVENTS), 2).when(et.isin(*ADD_EVENTS), 1).otherwise(2)
    d = S.to_yyyymmdd(F.col("event_date").cast("string"))
    return events.select(FEED, F.lit(service_id).alias("service_id"), d.alias("date"),
                         exc.alias("exception_type")).where(F.col("date").isNotNull())


def map_routes(operations: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """WN-02: one bus route per line, from the line's first row."""
    ops = operations.select(FEED, F.col("line_id").cast("string").alias("route_id"), "operating_lines", *order_cols)
    first = ordered.first_per_key(ops, [FEED, "route_id"], list(order_cols))
    return first.select(FEED, "route_id",
                        F.coalesce(F.col("operating_lines").cast("string"), F.col("route_id")).alias("route_short_name"),
                        F.lit(DEFAULT_ROUTE_TYPE).alias("route_type"))


def map_trips(operations: DataFrame, order_cols: Sequence[str], service_id: str = DEFAULT_SERVICE_ID) -> DataFrame:
    """WN-03: one trip per (line, direction), numbered per feed in first-seen order."""
    ops = operations.select(FEED, F.col("line_id").cast("string").alias("line_id"),
                            F.col("direction_id").cast("int").alias("direction_id"),
                            ordered.order_struct(order_cols).alias("_o"))
    firsts = ops.groupBy(FEED, "line_id", "direction_id").agg(F.min("_o").alias("_first"))
    numbered = ordered.dense_ordinal(firsts, [FEED], ["_first"], "_idx")
    return numbered.select(FEED, F.col("line_id").alias("route_id"), F.lit(service_id).alias("service_id"),
                           S.trip_id("line_id", "direction_id", "_idx").alias("trip_id"), "direction_id")


def map_stop_times(operations: DataFrame, trips: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """WN-04 + JN-04: interpolated times per (line, direction).

    The k-th stop by stop_sequence arrives at start + (k-1)(dwell + 120 s) and
    departs dwell later; start and dwell come from the lowest-sequence row.
    Positions come from an ordered scan over ranges, so a line may be of any length."""
    ops = operations.select(FEED, F.col("line_id").cast("string").alias("line_id"),
                            F.col("direction_id").cast("int").alias("direction_id"),
                            F.col("stop_id").cast("string").alias("stop_id"),
                            F.col("stop_sequence").cast("int").alias("stop_sequence"),
                            S.time_to_seconds(F.col("service_start_time").cast("string")).alias("_start"),
                            S.parse_duration_secs(F.col("average_dwell_time")).alias("_dwell"),
                            *order_cols)
    ranked = ordered.range_scan(ops, [FEED, "line_id", "direction_id"], ["stop_sequence", *order_cols],
                                first={"_start0": "_start", "_dwell0": "_dwell"}, index="_k")
    lookup = trips.select(FEED, F.col("route_id").alias("line_id"), "direction_id", "trip_id")
    joined = ranked.join(lookup, [FEED, "line_id", "direction_id"], "inner")
    start = F.coalesce(F.col("_start0"), F.lit(6 * 3600))
    arr = start + (F.col("_k") - 1) * (F.col("_dwell0") + DEFAULT_TRAVEL_SECS)
    return joined.select(FEED, "trip_id", S.seconds_to_time(arr).alias("arrival_time"),
                         S.seconds_to_time(arr + F.col("_dwell0")).alias("departure_time"),
                         "stop_id", "stop_sequence")


def map_agency(fleet: DataFrame) -> DataFrame:
    """AG-14: one agency per distinct operator."""
    ops = fleet.select(FEED, F.col("owner_operator").cast("string").alias("op")).where(F.col("op").isNotNull()).distinct()
    return ops.select(FEED, S.safe_id("op").alias("agency_id"), F.col("op").alias("agency_name"),
                      F.lit(DEFAULT_AGENCY_URL).alias("agency_url"),
                      F.lit(DEFAULT_AGENCY_TIMEZONE).alias("agency_timezone"))


def fleet_capacity(fleet: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """AG-09: one row per feed — truncated mean seated/total capacity, standing
    = total - seated when both are non-zero, first vehicle's model."""
    agg = fleet.groupBy(FEED).agg(
        F.avg("seated_capacity").cast("long").alias("seated_capacity"),
        F.avg("total_capacity").cast("long").alias("_total"),
        F.min_by(F.col("manufacturer_model").cast("string"), ordered.order_struct(order_cols)).alias("vehicle_description"),
    )
    both = (F.coalesce(F.col("_total"), F.lit(0)) != 0) & (F.coalesce(F.col("seated_capacity"), F.lit(0)) != 0)
    return agg.select(FEED, "seated_capacity",
                      F.when(both, F.col("_total") - F.col("seated_capacity")).alias("standing_capacity"),
                      "vehicle_description")


def map_trip_capacity(fleet: DataFrame, trips: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """JN-06: the fleet averages on every trip — an equi-join on feed with the
    one-row-per-feed capacity frame (never a cross join)."""
    cap = fleet_capacity(fleet, order_cols)
    return trips.select(FEED, "trip_id").join(cap, FEED, "inner").select(
        FEED, "trip_id", F.lit(None).cast("string").alias("service_date"), "vehicle_description",
        "seated_capacity", "standing_capacity")


def map_board_alight(passengers: DataFrame, trips: DataFrame) -> DataFrame:
    """JN-05: trip by (line, direction) — NULL direction is 0 — else the line's
    first trip, else the row is dropped."""
    t = trips.select(FEED, F.col("route_id").alias("line_id"), "direction_id", "trip_id")
    first = ordered.first_per_key(
        t.withColumn("_n", F.regexp_extract("trip_id", r"_(\d+)$", 1).cast("long")).select(FEED, "line_id", "trip_id", "_n"),
        [FEED, "line_id"], ["_n"]).select(FEED, "line_id", "trip_id")
    p = passengers.withColumn("line_id", F.col("line_id").cast("string")).withColumn(
        "direction_id", F.coalesce(F.col("direction_id").cast("int"), F.lit(0)))
    j = joins.fallback_lookup(p, t, ["line_id", "direction_id"], first, ["line_id"], "trip_id")
    ts_text = F.substring(F.col("timestamp").cast("string"), 1, 10)
    return j.select(
        FEED, "trip_id", F.col("stop_id").cast("string").alias("stop_id"), F.lit(0).alias("stop_sequence"),
        F.lit(0).alias("record_use"), F.coalesce(F.col("boarding_count").cast("long"), F.lit(0)).alias("boardings"),
        F.coalesce(F.col("alighting_count").cast("long"), F.lit(0)).alias("alightings"),
        F.col("number_of_users").cast("long").alias("current_load"),
        F.when(F.col("timestamp").isNotNull(), S.to_yyyymmdd(ts_text)).alias("service_date"))


def map_feed(datasets: Mapping[str, DataFrame], order_cols: Mapping[str, Sequence[str]],
             service_id: str = DEFAULT_SERVICE_ID) -> dict[str, DataFrame]:
    """The whole Silver → GTFS run: the GTFS tables that the given datasets
    yield, by the names of the upload schemas. Tables that need a dataset which
    is absent are absent too."""
    out: dict[str, DataFrame] = {}
    ops, fleet = datasets.get("Operations and Circulation"), datasets.get("Fleet Identification")
    if "Stop Spatial Features" in datasets:
        out["stops"] = map_stops(datasets["Stop Spatial Features"])
    if ops is not None:
        order = order_cols["Operations and Circulation"]
        out["routes"] = map_routes(ops, order)
        out["trips"] = map_trips(ops, order, service_id)
        out["stop_times"] = map_stop_times(ops, out["trips"], order)
    if "Stop Connections" in datasets:
        out["transfers"] = map_transfers(datasets["Stop Connections"], order_cols["Stop Connections"])
    if "Calendar Events" in datasets:
        out["calendar_dates"] = map_calendar_dates(datasets["Calendar Events"], service_id)
    if fleet is not None:
        out["agency"] = map_agency(fleet)
        if ops is not None:
            out["trip_capacity"] = map_trip_capacity(fleet, out["trips"], order_cols["Fleet Identification"])
    if "Transported Passengers" in datasets and ops is not None:
        out["board_alight"] = map_board_alight(datasets["Transported Passengers"], out["trips"])
    return out
