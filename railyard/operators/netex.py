"""GTFS → NeTEx translation as DataFrame operators (JN-14..21, AG-10..12, AG-20, PRJ-18..21).

Every entity is a row (nested structs/arrays only where the entity itself is
a short list: a trip's stop points, a station's quays). All ids are URNs
``PT:{codespace}:{type}:{local}`` (SC-03). Input frames carry ``feed_id``;
``order`` arguments name the input-order columns of each table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railyard.functions import scalars as S
from railyard.operators import ordered
from railyard.session import materialise

FEED = "feed_id"
CODESPACE_RE = re.compile(r"^[A-Z0-9]+$")
PLACEHOLDER_CODESPACES = ("FIXME",)
OTHER_MODE = "other"
#: The lists of a trip's calls, by the column of stop_times that each is of.
CALLS = {"stop_id": "stops", "arrival_time": "arrivals", "departure_time": "departures"}


@dataclass(frozen=True)
class Organisation:
    id: str
    name: str
    short_name: str | None = None
    contact_email: str | None = None


@dataclass(frozen=True)
class NetexConfig:
    codespace: str
    authority: Organisation
    operator: Organisation
    participant_ref: str | None = None
    default_lang: str = "pt"
    version: str = "1"
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        if not CODESPACE_RE.match(self.codespace or ""):
            raise ValueError(f"codespace must match {CODESPACE_RE.pattern}: {self.codespace!r}")

    @property
    def is_placeholder(self) -> bool:
        return self.codespace in PLACEHOLDER_CODESPACES

    def urn(self, kind: str, local: Column | str) -> Column:
        return S.build_urn(self.codespace, kind, F.lit(local) if isinstance(local, str) else local)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row, however often the
    body's own lambdas read it: a lambda's expressions are not shared."""
    return F.transform(F.array(value), body)[0]


def _txt(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- JN-14 / AG-10: modal vehicle mode per stop ------------------------------------
def stop_modes(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, st_order: Sequence[str]) -> DataFrame:
    """Most frequent mode over the stop_times rows at each stop; ties go to
    the mode met first in file order. Unmapped route types are skipped.

    Rows travel with the first column of the order alone; the whole order is read
    only where modes of a stop are equal in number and in that column."""
    rm = routes.select(FEED, "route_id", S.vehicle_mode("route_type").alias("mode")).where(F.col("mode").isNotNull())
    tm = trips.select(FEED, "trip_id", "route_id").join(rm, [FEED, "route_id"], "inner").select(FEED, "trip_id", "mode")
    st = stop_times.select(FEED, "trip_id", "stop_id", *dict.fromkeys(st_order))
    by_first = st.select(FEED, "trip_id", "stop_id", F.col(st_order[0]).alias("_o")).join(tm, [FEED, "trip_id"], "inner").groupBy(
        FEED, "stop_id", "mode").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first"), F.min(F.col("_o").isNotNull()).alias("_known"))
    # a stop has few modes: those that share the highest number and the first value (NULL comes first)
    rank = F.struct((-F.col("_n")).alias("n"), F.when(F.col("_known"), F.col("_first")).alias("first"))
    tops = by_first.groupBy(FEED, "stop_id").agg(F.collect_list(F.struct(rank.alias("rank"), "mode")).alias("_m")).select(
        FEED, "stop_id", F.filter("_m", lambda x: x["rank"] == F.array_min("_m")["rank"])["mode"].alias("_top"))
    if len(st_order) == 1:
        return tops.select(FEED, "stop_id", F.col("_top")[0].alias("mode"))
    tops = materialise(tops)
    tied = tops.where(F.size("_top") > 1)
    clear = tops.where(F.size("_top") == 1).select(FEED, "stop_id", F.col("_top")[0].alias("mode"))
    n = tied.count()
    if n == 0:
        return clear
    same = lambda a, b: a[FEED].eqNullSafe(b[FEED]) & a["stop_id"].eqNullSafe(b["stop_id"])
    if n <= ordered.SMALL_ROWS:
        t = tied.select(FEED, "stop_id")
        st = st.join(F.broadcast(t), same(st, t), "left_semi")
    firsts = st.select(FEED, "trip_id", "stop_id", ordered.order_struct(st_order).alias("_o")).join(tm, [FEED, "trip_id"], "inner").groupBy(
        FEED, "stop_id", "mode").agg(F.min("_o").alias("_o"))
    t = tied.select(F.col(FEED).alias("_f"), F.col("stop_id").alias("_s"), "_top")
    found = firsts.join(t, firsts[FEED].eqNullSafe(t["_f"]) & firsts["stop_id"].eqNullSafe(t["_s"]), "inner").where(
        F.array_contains("_top", F.col("mode"))).groupBy(FEED, "stop_id").agg(F.min_by("mode", "_o").alias("mode"))
    return clear.unionByName(found)


# --- JN-15 / PRJ-20: stop places and quays ---------------------------------------------
def stop_places(stops: DataFrame, modes: DataFrame, cfg: NetexConfig, order: Sequence[str]) -> DataFrame:
    """StopPlaces with their quays.

    * location_type 1 → a StopPlace (kept even without quays);
    * location_type 0 under a station → a quay of it;
    * location_type 0 under an existing non-station → a quay of a StopPlace
      made for that parent;
    * location_type 0 without an existing parent → ``<id>_place`` with one quay;
    * location types 2..4 are not translated (they may still be parents).
    A place's quays stand in file order, with the stop's code (else its platform
    code) as public code. A place's mode is the modal mode of its child stops (first met on ties);
    an orphan place takes its own stop's mode; ``other`` when unserved.
    """
    lt = F.coalesce(F.col("location_type").cast("int"), F.lit(0))
    codes = [F.when(_txt(c) != "", _txt(c)) for c in ("stop_code", "platform_code") if c in stops.columns]
    s = stops.select(FEED, _txt("stop_id").alias("stop_id"), "stop_name", "stop_lat", "stop_lon",
                     _txt("parent_station").alias("parent_station"), lt.alias("lt"),
                     F.coalesce(*codes, F.lit(None).cast("string")).alias("public_code"),
                     ordered.order_struct(order).alias("_o"))
    m = modes.select(FEED, _txt("stop_id").alias("stop_id"), "mode")
    parents = s.select(FEED, F.col("stop_id").alias("parent_station"), F.col("lt").alias("_plt"),
                       F.col("stop_name").alias("_pname"), F.col("stop_lat").alias("_plat"),
                       F.col("stop_lon").alias("_plon"))
    q = s.where(F.col("lt") == 0).join(parents, [FEED, "parent_station"], "left").join(m, [FEED, "stop_id"], "left")
    has_parent = F.col("parent_station").isNotNull() & F.col("_plt").isNotNull()
    place_key = F.when(has_parent, F.col("parent_station")).otherwise(F.concat(F.col("stop_id"), F.lit("_place")))
    quays = q.select(
        FEED, place_key.alias("place_key"), has_parent.alias("_has_parent"), "stop_id", "mode", "_o",
        F.when(has_parent, F.coalesce(F.col("_pname"), F.col("parent_station")))
        .otherwise(F.coalesce(F.col("stop_name"), F.col("stop_id"))).alias("_name"),
        F.when(has_parent, S.centroid("_plat", "_plon")).otherwise(S.centroid("stop_lat", "stop_lon")).alias("_centroid"),
        F.struct(F.col("_o"), cfg.urn("Quay", F.col("stop_id")).alias("id"), F.col("stop_name").alias("name"),
                 S.centroid("stop_lat", "stop_lon").alias("centroid"), F.col("public_code")).alias("_quay"))
    # modal mode of a place's quays (children); orphan places have exactly one quay
    mc = quays.where(F.col("mode").isNotNull()).groupBy(FEED, "place_key", "mode").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first"))
    pm = mc.groupBy(FEED, "place_key").agg(F.min_by("mode", F.struct(-F.col("_n"), F.col("_first"))).alias("_mode"))
    grouped = quays.groupBy(FEED, "place_key").agg(
        F.first("_name").alias("name"), F.first("_centroid").alias("centroid"),
        F.transform(F.array_sort(F.collect_list("_quay")), lambda x: x.dropFields("_o")).alias("quays"))
    from_quays = grouped.join(pm, [FEED, "place_key"], "left")
    stations = s.where(F.col("lt") == 1).select(
        FEED, F.col("stop_id").alias("place_key"), F.coalesce("stop_name", "stop_id").alias("name"),
        S.centroid("stop_lat", "stop_lon").alias("centroid"))
    st_only = stations.join(from_quays.select(FEED, "place_key"), [FEED, "place_key"], "left_anti").select(
        FEED, "place_key", "name", "centroid", F.array().cast(from_quays.schema["quays"].dataType).alias("quays"),
        F.lit(None).cast("string").alias("_mode"))
    # a station that has quays takes its own row's name/centroid
    st_names = stations.select(FEED, "place_key", F.col("name").alias("_sn"), F.col("centroid").alias("_sc"))
    fq = from_quays.join(st_names, [FEED, "place_key"], "left").select(
        FEED, "place_key", F.coalesce("_sn", "name").alias("name"), F.coalesce("_sc", "centroid").alias("centroid"),
        "quays", "_mode")
    allp = fq.unionByName(st_only)
    return allp.select(
        FEED, "place_key", cfg.urn("StopPlace", F.col("place_key")).alias("id"), "name", "centroid",
        F.coalesce("_mode", F.lit(OTHER_MODE)).alias("transport_mode"), "quays")


# --- JN-19: scheduled stop points and stop assignments ----------------------------------
def stop_points(stops: DataFrame, cfg: NetexConfig, order: Sequence[str]) -> DataFrame:
    """One ScheduledStopPoint + PassengerStopAssignment per location_type 0 stop,
    ordered per feed in file order (WN-06 over the reduced stop rows)."""
    lt = F.coalesce(F.col("location_type").cast("int"), F.lit(0))
    s = stops.where(lt == 0).select(FEED, _txt("stop_id").alias("stop_id"), "stop_name",
                                    ordered.order_struct(order).alias("_o"))
    n = ordered.dense_ordinal(s, [FEED], ["_o"], "order")
    return n.select(FEED, "stop_id", cfg.urn("ScheduledStopPoint", F.col("stop_id")).alias("ssp_id"),
                    F.col("stop_name").alias("name"),
                    cfg.urn("PassengerStopAssignment", F.col("stop_id")).alias("psa_id"), "order",
                    cfg.urn("Quay", F.col("stop_id")).alias("quay_ref"))


# --- PRJ-18: lines -------------------------------------------------------------------
def lines(routes: DataFrame, cfg: NetexConfig) -> DataFrame:
    def nz(c):
        return F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) if c in routes.columns else F.lit(None)

    return routes.select(
        FEED, _txt("route_id").alias("route_id"), cfg.urn("Line", _txt("route_id")).alias("id"),
        F.coalesce(nz("route_long_name"), nz("route_short_name"), _txt("route_id")).alias("name"),
        (_txt("route_short_name") if "route_short_name" in routes.columns else F.lit(None)).alias("public_code"),
        S.vehicle_mode("route_type").alias("transport_mode"),
        cfg.urn("Operator", F.coalesce(_txt("agency_id"), F.lit(cfg.operator.id))).alias("operator_ref"),
        (F.col("route_color") if "route_color" in routes.columns else F.lit(None).cast("string")).alias("colour"),
        (F.col("route_text_color") if "route_text_color" in routes.columns else F.lit(None).cast("string"))
        .alias("text_colour"))


def preflight(routes: DataFrame, cfg: NetexConfig) -> DataFrame:
    """PRJ-21 (data part): routes whose route_type has no NeTEx mode, plus a
    placeholder codespace issue."""
    bad = routes.where(S.vehicle_mode("route_type").isNull()).select(
        FEED, F.lit("error").alias("severity"),
        F.format_string("Route '%s' has unmapped route_type %s", _txt("route_id"), _txt("route_type")).alias("message"))
    if cfg.is_placeholder:
        ph = routes.select(FEED).distinct().select(FEED, F.lit("error").alias("severity"),
                                                   F.lit("Codespace is a placeholder").alias("message"))
        bad = bad.unionByName(ph)
    return bad


# --- PRJ-19: organisations ---------------------------------------------------------------
def organisations(agencies: DataFrame, cfg: NetexConfig, order: Sequence[str]) -> DataFrame:
    """Authority and primary operator from config, then one operator per further
    agency id (first row wins, the primary operator's id excluded)."""
    a = agencies.select(FEED, F.coalesce(_txt("agency_id"), F.lit(cfg.operator.id)).alias("oid"),
                        _txt("agency_name").alias("aname"),
                        (F.col("agency_email") if "agency_email" in agencies.columns else F.lit(None).cast("string"))
                        .alias("email"), *order)
    a = a.where(F.col("oid") != cfg.operator.id)
    first = ordered.first_per_key(a, [FEED, "oid"], list(order))
    extra = first.select(FEED, cfg.urn("Operator", F.col("oid")).alias("id"), F.lit("Operator").alias("kind"),
                         F.coalesce("aname", "oid").alias("name"), F.lit(None).cast("string").alias("short_name"),
                         F.col("email").alias("contact_email"))
    feeds = agencies.select(FEED).distinct()
    fixed = []
    for kind, org in (("Authority", cfg.authority), ("Operator", cfg.operator)):
        fixed.append(feeds.select(FEED, cfg.urn(kind, org.id).alias("id"), F.lit(kind).alias("kind"),
                                  F.lit(org.name).alias("name"), F.lit(org.short_name).cast("string").alias("short_name"),
                                  F.lit(org.contact_email).cast("string").alias("contact_email")))
    return fixed[0].unionByName(fixed[1]).unionByName(extra)


# --- AG-11 / JN-16 / WN-06: journey patterns -----------------------------------------------
def trip_calls(stop_times: DataFrame, st_order: Sequence[str]) -> DataFrame:
    """(feed, trip, a list for each of ``CALLS``): a trip's stop_times by
    stop_sequence, then file order; rows of no trip are left out. Such a frame is
    returned as it is, so that one written by the caller serves stop lists and times
    without another shuffle of the rows. Rows are dealt by trip before they are
    gathered: a slice of the input seldom has many rows of a trip, and gathering
    within it would sort, and so spill, the slice.

    A trip's list is bounded by its length; ``collect_list`` per trip is safe."""
    if CALLS["stop_id"] in stop_times.columns:
        return stop_times
    kept = [c for c in CALLS if c in stop_times.columns]
    order = list(dict.fromkeys(["stop_sequence", *st_order]))
    st = stop_times.where(F.col(FEED).isNotNull() & F.col("trip_id").isNotNull()).select(
        *dict.fromkeys([FEED, "trip_id", *order, *kept]))
    call = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *kept)
    # feed_id may be a fixed value, which no grouping counts as a key: dealt by trip alone
    per = st.repartition("trip_id").groupBy(FEED, "trip_id").agg(F.sort_array(F.collect_list(call)).alias("_l"))
    return per.select(FEED, "trip_id", *[F.col("_l")[c].alias(CALLS[c]) for c in kept])


def written_trips(trips: DataFrame, stop_times: DataFrame, trip_order: Sequence[str],
                  st_order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(trips, their calls), both written once, for what reads them more than once.
    Read back, they meet by (feed, trip) in every join, so the calls are dealt once."""
    names = [c for c in ("trip_short_name", "trip_headsign") if c in trips.columns]
    kept = dict.fromkeys([FEED, "trip_id", "route_id", "service_id", "direction_id", *names, *trip_order])
    return materialise(trips.select(*kept)), materialise(trip_calls(stop_times, st_order))


def trip_stop_lists(stop_times: DataFrame, st_order: Sequence[str]) -> DataFrame:
    """(feed, trip, stops array ordered by stop_sequence then file order)."""
    return trip_calls(stop_times.drop("arrival_time", "departure_time"), st_order).select(FEED, "trip_id", "stops")


def journey_patterns(trips: DataFrame, stop_times: DataFrame, cfg: NetexConfig, trip_order: Sequence[str],
                     st_order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Patterns deduplicated by (route, direction, stop list) — NULL and 0
    directions stay apart — numbered per feed in first-seen trip order.
    Returns (patterns, trip → pattern).

    ``stop_times`` are rows or the lists of ``trip_calls``. The stop lists are built
    and written once; a list is named by two 64-bit hashes, and only the names
    travel when patterns are found and joined. Trips with their patterns are
    written once too, as journeys and times both read them."""
    lists = trip_stop_lists(stop_times, st_order)
    t = trips.select(FEED, "trip_id", "route_id", "direction_id", ordered.order_struct(trip_order).alias("_o"))
    tl = materialise(t.join(lists, [FEED, "trip_id"], "inner")
                     .withColumn("_h1", F.xxhash64("stops")).withColumn("_h2", F.xxhash64(F.size("stops"), "stops")))
    pk = [FEED, "route_id", "direction_id", "_h1", "_h2"]
    pats = tl.groupBy(*pk).agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("n_trips"), F.first("stops").alias("stops"))
    pats = ordered.dense_ordinal(pats, [FEED], ["_first"], "_n")
    local = F.format_string("%s_%d_%d", _txt("route_id"), F.coalesce(F.col("direction_id").cast("int"), F.lit(0)),
                            F.col("_n"))
    pats = pats.withColumn("local_id", local)
    patterns = pats.select(
        FEED, "local_id", cfg.urn("JourneyPattern", F.col("local_id")).alias("id"), "route_id", "direction_id",
        cfg.urn("Line", _txt("route_id")).alias("line_ref"), S.direction_label("direction_id").alias("direction_type"),
        "stops", F.size("stops").alias("n_stops"), F.col("n_trips").cast("long").alias("n_trips"), "_n")
    # trips find their pattern by the same null-safe key
    cond = [tl[FEED] == pats[FEED], tl["route_id"] == pats["route_id"],
            tl["direction_id"].eqNullSafe(pats["direction_id"]), tl["_h1"] == pats["_h1"], tl["_h2"] == pats["_h2"]]
    t2p = tl.join(pats.select(*pk, "local_id"), cond, "inner").select(
        tl[FEED], tl["trip_id"], tl["route_id"], F.col("local_id"))
    return patterns, materialise(t2p)


def stop_points_in_pattern(patterns: DataFrame, cfg: NetexConfig, lists: bool = False) -> DataFrame:
    """StopPointInJourneyPattern rows (position = order); with ``lists`` the
    patterns themselves, each with the list of its points."""
    def point(own: Column, pos: Column, stop: Column) -> list[Column]:
        return [(pos + 1).alias("order"), F.concat(own, (pos + 1).cast("string")).alias("id"),
                cfg.urn("ScheduledStopPoint", _txt(stop)).alias("ssp_ref")]

    own = cfg.urn("StopPointInJourneyPattern", F.format_string("%s_", F.col("local_id")))
    if lists:
        return patterns.withColumn("points", _bound(own, lambda o: F.transform("stops", lambda s, i: F.struct(*point(o, i, s)))))
    x = patterns.select(FEED, "local_id", F.posexplode("stops").alias("_pos", "stop_id"))
    return x.select(FEED, "local_id", *point(own, F.col("_pos"), F.col("stop_id")))


# --- JN-18 / SC-11: service journeys and passing times ----------------------------------------
def passing_times(stop_times: DataFrame, trip_patterns: DataFrame, cfg: NetexConfig,
                  st_order: Sequence[str], lists: bool = False) -> DataFrame:
    """One TimetabledPassingTime per stop_time of a trip that has a pattern,
    matched to the pattern's stop point by position (a strict superset of
    matching by stop_sequence). Times keep hours mod 24 plus a day offset.
    With ``lists``, one row per trip with the list of its times. A trip id that
    comes with several patterns has each of its calls once for each."""
    calls = trip_calls(stop_times, st_order)
    per = trip_patterns.groupBy(FEED, "trip_id").agg(F.sort_array(F.collect_list("local_id")).alias("_locals"))
    x = calls.join(per, [FEED, "trip_id"], "inner")

    def time(own: Column, ref: Column, idx: Column, arr: Column, dep: Column) -> list[Column]:
        return [
            idx.cast("long").alias("idx"), F.concat(own, idx.cast("string")).alias("id"),
            F.concat(ref, idx.cast("string")).alias("spjp_ref"),
            arr["time"].alias("arrival_time"), arr["day_offset"].alias("arrival_day_offset"),
            dep["time"].alias("departure_time"), dep["day_offset"].alias("departure_day_offset")]

    own = cfg.urn("TimetabledPassingTime", F.format_string("%s_", _txt("trip_id")))
    ref = lambda local: cfg.urn("StopPointInJourneyPattern", F.format_string("%s_", local))
    place = lambda k, j: k * F.size("_locals") + j + 1
    if lists:
        def parts(c):
            cut = F.transform(c, lambda x: F.struct(x.alias("text"), F.split(x, ":").alias("parts")))
            return F.transform(cut, lambda x: S.gtfs_time_parts(x["text"], x["parts"]))

        once = F.struct(own.alias("own"), F.transform("_locals", ref).alias("refs"), parts("departures").alias("dep"))
        return x.select(FEED, "trip_id", _bound(once, lambda b: F.flatten(F.transform(
            parts("arrivals"), lambda a, k: F.transform(b["refs"], lambda r, j: F.struct(
                *time(b["own"], r, place(k, j), a, F.get(b["dep"], k))))))).alias("times"))
    x = x.select(FEED, "trip_id", "departures", "_locals", F.posexplode("arrivals").alias("_k", "_arr"))
    x = x.select("*", F.posexplode("_locals").alias("_j", "local_id"))
    return x.select(FEED, "trip_id", *time(own, ref(F.col("local_id")), place(F.col("_k"), F.col("_j")), S.gtfs_time_parts("_arr"),
                                           S.gtfs_time_parts(F.get("departures", F.col("_k")))))


def service_journeys(trips: DataFrame, trip_patterns: DataFrame, cfg: NetexConfig) -> DataFrame:
    """ServiceJourney header rows (passing times are a separate frame)."""
    t = trips.join(trip_patterns.select(FEED, "trip_id", "local_id"), [FEED, "trip_id"], "inner")
    name = F.coalesce(*[F.col(c) for c in ("trip_short_name", "trip_headsign") if c in trips.columns],
                      F.lit(None).cast("string"))
    return t.select(FEED, "trip_id", cfg.urn("ServiceJourney", _txt("trip_id")).alias("id"), name.alias("name"),
                    cfg.urn("Line", _txt("route_id")).alias("line_ref"),
                    cfg.urn("JourneyPattern", F.col("local_id")).alias("journey_pattern_ref"),
                    cfg.urn("DayType", _txt("service_id")).alias("day_type_ref"),
                    cfg.urn("Operator", F.lit(cfg.operator.id)).alias("operator_ref"))


def journeys_per_line(journeys: DataFrame) -> DataFrame:
    """AG-20: journey count per line (the timetable document key)."""
    return journeys.groupBy(FEED, "line_ref").agg(F.count(F.lit(1)).cast("long").alias("n_journeys"))


# --- JN-17 / SC-16 / AG-12: calendar fold ---------------------------------------------------
def calendar_fold(calendar: DataFrame, calendar_dates: DataFrame, cfg: NetexConfig, cal_order: Sequence[str],
                  cd_order: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(day types, operating periods, day type assignments).

    Every service of either table is a DayType (weekdays from its calendar
    row); each calendar row is an OperatingPeriod plus an available
    assignment; each calendar_dates row a dated assignment (available iff
    exception 1). Assignment order: calendar rows, then calendar_dates rows,
    each in file order, numbered per feed."""
    sids = calendar.select(FEED, _txt("service_id").alias("service_id")).unionByName(
        calendar_dates.select(FEED, _txt("service_id").alias("service_id"))).distinct()
    dow = calendar.select(FEED, _txt("service_id").alias("service_id"),
                          F.array_join(S.days_of_week(), " ").alias("days_of_week"))
    day_types = sids.join(dow, [FEED, "service_id"], "left").select(
        FEED, "service_id", cfg.urn("DayType", F.col("service_id")).alias("id"), F.col("service_id").alias("name"),
        F.coalesce("days_of_week", F.lit("")).alias("days_of_week"))
    periods = calendar.select(
        FEED, _txt("service_id").alias("service_id"), cfg.urn("OperatingPeriod", _txt("service_id")).alias("id"),
        F.date_format("start_date", "yyyy-MM-dd").alias("from_date"),
        F.date_format("end_date", "yyyy-MM-dd").alias("to_date"))
    a1 = calendar.select(FEED, _txt("service_id").alias("service_id"), ordered.order_struct(cal_order).alias("_o"),
                         F.concat(_txt("service_id"), F.lit("_period")).alias("_local"),
                         cfg.urn("OperatingPeriod", _txt("service_id")).alias("operating_period_ref"),
                         F.lit(None).cast("string").alias("date"), F.lit(True).alias("is_available"))
    a2 = calendar_dates.select(FEED, _txt("service_id").alias("service_id"), ordered.order_struct(cd_order).alias("_o"),
                               F.concat(_txt("service_id"), F.lit("_"), S.date_to_yyyymmdd("date")).alias("_local"),
                               F.lit(None).cast("string").alias("operating_period_ref"),
                               F.date_format("date", "yyyy-MM-dd").alias("date"),
                               (F.col("exception_type") == 1).alias("is_available"))
    n1 = ordered.dense_ordinal(a1, [FEED], ["_o"], "order").drop("_o")
    n2 = ordered.dense_ordinal(a2, [FEED], ["_o"], "_o2").drop("_o")
    first_section = a1.groupBy(FEED).agg(F.count(F.lit(1)).alias("_n1"))  # one row per feed
    n2 = n2.join(first_section, FEED, "left").withColumn(
        "order", (F.coalesce("_n1", F.lit(0)) + F.col("_o2")).cast("long")).drop("_n1", "_o2")
    numbered = n1.unionByName(n2)
    assignments = numbered.select(
        FEED, cfg.urn("DayTypeAssignment", F.col("_local")).alias("id"), "order",
        cfg.urn("DayType", F.col("service_id")).alias("day_type_ref"), "operating_period_ref", "date", "is_available")
    return day_types, periods, assignments


def validity(periods: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """AG-12: earliest from / latest to per feed (of ``feeds``, or those with a
    period); today .. +1 year when a feed has no period."""
    agg = periods.groupBy(FEED).agg(F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date"))
    if feeds is not None:
        agg = feeds.select(FEED).distinct().join(agg, FEED, "left")
    return agg.select(FEED, F.coalesce("from_date", F.date_format(F.current_date(), "yyyy-MM-dd")).alias("from_date"),
                      F.coalesce("to_date", F.date_format(F.add_months(F.current_date(), 12), "yyyy-MM-dd"))
                      .alias("to_date"))
