"""Service calendar expansion, feed analytics and restriction (AG-15..19, SO-02/04, JN-12/13).

Definitions (the GTFS data model):
* active(service, date): weekday bit set and start <= date <= end, unless
  removed by exception 2; or added by exception 1.
* restrict_to_routes(R): trips of R; their stop_times; stops used plus their
  parent stations; routes used; agencies used (a NULL agency_id keeps all);
  calendar rows of used services; shapes and frequencies of kept trips;
  transfers with both ends kept; feed_info unchanged.
* restrict_to_dates(D): trips whose service is active on a date of D, then
  the same cascade.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard.functions import scalars as S
from railyard.operators import ordered
from railyard.session import materialise

FEED = "feed_id"


def active_service_dates(calendar: DataFrame | None, calendar_dates: DataFrame | None) -> DataFrame:
    """AG-16 / SO-02: (feed_id, service_id, date) — (weekly − removed) ∪ added."""
    frames = []
    if calendar is not None:
        bits = F.array(*[F.col(d).cast("int") for d in S.WEEKDAY_COLUMNS])
        days = calendar.select(FEED, "service_id", bits.alias("_bits"),
                               F.explode(F.sequence(F.col("start_date"), F.col("end_date"))).alias("date"))
        weekly = days.where(F.element_at("_bits", F.weekday("date") + 1) == 1).select(FEED, "service_id", "date")
        frames.append(weekly)
    if calendar_dates is None:
        out = frames[0]
    else:
        removed = calendar_dates.where(F.col("exception_type") == 2).select(FEED, "service_id", "date")
        added = calendar_dates.where(F.col("exception_type") == 1).select(FEED, "service_id", "date")
        base = frames[0].join(removed, [FEED, "service_id", "date"], "left_anti") if frames else None
        out = added if base is None else base.unionByName(added)
    return out.distinct()


def date_span(active: DataFrame) -> DataFrame:
    """Span start/end and number of active dates per feed."""
    return active.groupBy(FEED).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
                                    F.count_distinct("date").alias("active_dates"))


def trips_per_date(active: DataFrame, trips: DataFrame) -> DataFrame:
    """AG-17: trips running on each date. Trips are first counted per service
    (pre-aggregation), so the join is services x dates, not trips x dates."""
    per_service = trips.groupBy(FEED, "service_id").agg(F.count(F.lit(1)).alias("_n"))
    j = active.join(per_service, [FEED, "service_id"], "inner")
    return j.groupBy(FEED, "date").agg(F.sum("_n").cast("long").alias("num_trips"))


def busiest_date(per_date: DataFrame) -> DataFrame:
    """Most trips; the earliest date on ties."""
    key = F.struct(F.col("num_trips"), -F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")))
    return per_date.groupBy(FEED).agg(F.max_by("date", key).alias("busiest_date"),
                                      F.max("num_trips").alias("num_trips"))


def bounds(stops: DataFrame) -> DataFrame:
    """AG-15: bounding box and centroid (mean of stop coordinates)."""
    return stops.groupBy(FEED).agg(
        F.min("stop_lon").alias("min_lon"), F.min("stop_lat").alias("min_lat"),
        F.max("stop_lon").alias("max_lon"), F.max("stop_lat").alias("max_lat"),
        F.avg("stop_lat").alias("centroid_lat"), F.avg("stop_lon").alias("centroid_lon"))


def health(tables: Mapping[str, DataFrame]) -> DataFrame:
    """AG-19: health indicators in long form (feed_id, indicator, value).

    Every indicator is a conditional count inside one aggregate per table,
    so a zero still yields a row; "without" indicators use a left join flag."""
    routes, trips, stops = tables["routes"], tables["trips"], tables["stops"]
    st, shapes = tables.get("stop_times"), tables.get("shapes")
    one = F.lit(1)

    def kv(name, col):
        return F.struct(F.lit(name).alias("indicator"), col.cast("long").alias("value"))

    def longify(agg_df):
        return agg_df.select(FEED, F.explode(F.array(*[c for c in agg_df.columns if c != FEED])).alias("_kv")).select(
            FEED, "_kv.indicator", "_kv.value")

    no_shape = F.col("shape_id").isNull() if "shape_id" in trips.columns else F.lit(True)
    used_routes = trips.select(FEED, "route_id").distinct().withColumn("_u", F.lit(True))
    r = routes.join(used_routes, [FEED, "route_id"], "left").groupBy(FEED).agg(
        kv("routes", F.count(one)).alias("a"), kv("routes_without_trips", F.count_if(F.col("_u").isNull())).alias("b"))
    t = trips.groupBy(FEED).agg(kv("trips", F.count(one)).alias("a"),
                                kv("trips_without_shape", F.count_if(no_shape)).alias("b"))
    parts = [longify(r), longify(t)]
    if st is not None:
        used = st.select(FEED, "stop_id").distinct().withColumn("_u", F.lit(True))
        s = stops.join(used, [FEED, "stop_id"], "left").groupBy(FEED).agg(
            kv("stops", F.count(one)).alias("a"), kv("stops_without_trips", F.count_if(F.col("_u").isNull())).alias("b"))
        x = st.groupBy(FEED).agg(
            kv("stop_times_without_departure", F.count_if(F.col("departure_secs").isNull())).alias("a"),
            kv("stop_times_without_arrival", F.count_if(F.col("arrival_secs").isNull())).alias("b"))
        parts += [longify(s), longify(x)]
    else:
        parts.append(longify(stops.groupBy(FEED).agg(kv("stops", F.count(one)).alias("a"))))
    if shapes is not None:
        parts.append(longify(shapes.groupBy(FEED).agg(kv("shapes", F.count_distinct("shape_id")).alias("a"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Mean radius of the earth in kilometres.
EARTH_RADIUS_KM = 6371.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance along the sphere between two positions in degrees, in the form of
    the haversine that keeps its digits near the antipode too."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    across = F.sqrt(F.pow(F.cos(b) * F.sin(d), 2) + F.pow(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d), 2))
    return F.lit(EARTH_RADIUS_KM) * F.atan2(across, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))


def path_lengths(stop_times: DataFrame, stops: DataFrame, stop_order: Sequence[str] = ("stop_sequence",)) -> DataFrame:
    """(feed_id, trip_id, path_km): great-circle distance from stop to stop in
    ``stop_order``. Calls at stops without a position in range are passed over;
    a trip with fewer than two positions has none."""
    lat, lon = F.col("stop_lat").try_cast("double"), F.col("stop_lon").try_cast("double")
    placed = stops.where(lat.between(-90, 90) & lon.between(-180, 180)).groupBy(FEED, "stop_id").agg(F.min(F.struct(lat.alias("lat"), lon.alias("lon"))).alias("_at"))
    calls = stop_times.select(FEED, "trip_id", "stop_id", *stop_order).join(placed, [FEED, "stop_id"])
    legs = ordered.range_scan(calls, [FEED, "trip_id"], list(stop_order), lag={"_from": "_at"})
    km = great_circle_km(F.col("_from.lat"), F.col("_from.lon"), F.col("_at.lat"), F.col("_at.lon"))
    return legs.groupBy(FEED, "trip_id").agg(F.sum(km).alias("path_km"))


def route_stats(active: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame | None = None,
                stop_order: Sequence[str] = ("stop_sequence",)) -> DataFrame:
    """AG-18 for the first active day of each feed: trips, mean headway
    (minutes, successive starts per direction), service hours, distance and
    speed per route. A trip's distance is its largest shape_dist_traveled or,
    where that is absent and ``stops`` are given, the great-circle distance
    along its stops."""
    first_day = active.groupBy(FEED).agg(F.min("date").alias("date"))
    services = active.join(first_day, [FEED, "date"], "left_semi").select(FEED, "service_id").distinct()
    day_trips = trips.join(services, [FEED, "service_id"], "left_semi")
    per_trip = stop_times.groupBy(FEED, "trip_id").agg(
        F.min("arrival_secs").alias("_start"), F.max("arrival_secs").alias("_end"),
        F.max("shape_dist_traveled").cast("double").alias("_dist"))
    t = day_trips.select(FEED, "trip_id", "route_id", "direction_id").join(per_trip, [FEED, "trip_id"], "inner")
    if stops is not None:
        t = materialise(t)
        unmeasured = t.where(F.col("_dist").isNull()).select(FEED, "trip_id").distinct()
        paths = path_lengths(stop_times.join(unmeasured, [FEED, "trip_id"], "left_semi"), stops, stop_order)
        t = t.join(paths, [FEED, "trip_id"], "left").withColumn("_dist", F.coalesce("_dist", "path_km"))
    t = ordered.range_scan(t, [FEED, "route_id", "direction_id"], ["_start", "trip_id"], lag={"_before": "_start"})
    t = t.withColumn("_gap", F.col("_start") - F.col("_before"))
    agg = t.groupBy(FEED, "route_id").agg(
        F.count(F.lit(1)).alias("num_trips"), F.avg("_gap").alias("_gap"),
        F.sum((F.col("_end") - F.col("_start")) / 3600.0).alias("service_duration"),
        F.sum("_dist").alias("service_distance"))
    return agg.join(first_day, FEED).select(
        FEED, "date", "route_id", F.col("num_trips").cast("long").alias("num_trips"),
        F.round(F.col("_gap") / 60.0, 6).alias("mean_headway"),
        F.round("service_duration", 6).alias("service_duration"),
        F.round("service_distance", 6).alias("service_distance"),
        F.round(F.when(F.col("service_duration") > 0, F.col("service_distance") / F.col("service_duration")), 6)
        .alias("service_speed"))


def restrict_to_trips(tables: Mapping[str, DataFrame], kept_trips: DataFrame) -> dict[str, DataFrame]:
    """The restriction cascade from a set of kept trips (feed_id, trip_id).

    The keys of the kept trips and the stops they use are written once; every
    table is then one semi join against them."""
    kt = kept_trips.select(FEED, "trip_id").distinct()
    out: dict[str, DataFrame] = {}
    trips = tables["trips"].join(kt, [FEED, "trip_id"], "left_semi")
    wanted = [c for c in ("trip_id", "route_id", "service_id", "shape_id") if c in trips.columns]
    keys = materialise(trips.select(FEED, *wanted))
    kt = keys.select(FEED, "trip_id").distinct()
    out["trips"] = tables["trips"].join(kt, [FEED, "trip_id"], "left_semi")
    st = tables.get("stop_times")
    if st is not None:
        out["stop_times"] = st.join(kt, [FEED, "trip_id"], "left_semi")
        used = materialise(out["stop_times"].select(FEED, "stop_id").distinct())
        stops = tables["stops"]
        direct = stops.join(used, [FEED, "stop_id"], "left_semi")
        parents = direct.where(F.col("parent_station").isNotNull()).select(
            FEED, F.col("parent_station").alias("stop_id")).distinct()
        out["stops"] = stops.join(used.unionByName(parents), [FEED, "stop_id"], "left_semi")
    routes = tables["routes"].join(keys.select(FEED, "route_id").distinct(), [FEED, "route_id"], "left_semi")
    out["routes"] = routes
    if "agency" in tables:
        ag = routes.select(FEED, "agency_id")
        null_feeds = ag.where(F.col("agency_id").isNull()).select(FEED).distinct()
        by_id = tables["agency"].join(ag.where(F.col("agency_id").isNotNull()).distinct(), [FEED, "agency_id"], "left_semi")
        all_of_feed = tables["agency"].join(null_feeds, FEED, "left_semi")
        out["agency"] = by_id.unionByName(all_of_feed).distinct()
    svc = keys.select(FEED, "service_id").distinct()
    for t in ("calendar", "calendar_dates"):
        if t in tables:
            out[t] = tables[t].join(svc, [FEED, "service_id"], "left_semi")
    if "shapes" in tables and "shape_id" in wanted:
        out["shapes"] = tables["shapes"].join(keys.select(FEED, "shape_id").distinct(), [FEED, "shape_id"], "left_semi")
    if "frequencies" in tables:
        out["frequencies"] = tables["frequencies"].join(kt, [FEED, "trip_id"], "left_semi")
    if "transfers" in tables and "stops" in out:
        ks = out["stops"].select(FEED, "stop_id")
        tr = tables["transfers"].join(ks.withColumnRenamed("stop_id", "from_stop_id"), [FEED, "from_stop_id"], "left_semi")
        out["transfers"] = tr.join(ks.withColumnRenamed("stop_id", "to_stop_id"), [FEED, "to_stop_id"], "left_semi")
    if "feed_info" in tables:
        out["feed_info"] = tables["feed_info"]
    return out


def restrict_to_routes(tables: Mapping[str, DataFrame], route_ids: DataFrame) -> dict[str, DataFrame]:
    """JN-12: ``route_ids`` (feed_id, route_id)."""
    kept = tables["trips"].join(route_ids.select(FEED, "route_id").distinct(), [FEED, "route_id"], "left_semi")
    return restrict_to_trips(tables, kept.select(FEED, "trip_id"))


def restrict_to_dates(tables: Mapping[str, DataFrame], dates: DataFrame) -> dict[str, DataFrame]:
    """JN-13 / SO-04: ``dates`` (feed_id, date); active dates ∩ wanted dates."""
    active = active_service_dates(tables.get("calendar"), tables.get("calendar_dates"))
    svc = active.join(dates.select(FEED, "date").distinct(), [FEED, "date"], "left_semi").select(FEED, "service_id").distinct()
    kept = tables["trips"].join(svc, [FEED, "service_id"], "left_semi")
    return restrict_to_trips(tables, kept.select(FEED, "trip_id"))


def counts_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.groupBy(FEED).agg(F.count(F.lit(1)).cast("long").alias("records")).withColumn("table_name", F.lit(n))
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(FEED, "table_name", "records")
