"""Fixture tests: the small feeds and accept/reject values of FIXTURES.md."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from railyard import catalog, schemas
from railyard.functions import scalars as S
from railyard.operators import features as FE
from railyard.operators import joins, mapping, netex as NX, quality, service, store, validate as V

FEED = "F"


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- §4 accept / reject values --------------------------------------------------------------

@pytest.mark.parametrize("table,field,ok,bad", [
    ("stops", "stop_lat", ["41.1496"], ["91.0", "95.0"]),
    ("stops", "stop_lon", ["-8.6109"], ["-181.0"]),
    ("stops", "location_type", ["4"], ["5"]),
    ("routes", "route_color", ["FF0000"], ["#FF0000", "F00"]),
    ("trips", "direction_id", ["0"], ["2"]),
    ("stop_times", "arrival_time", ["08:30:00", "25:10:00", None], ["8:30", "6am"]),
    ("calendar", "start_date", ["20260101"], ["2026-01-01", "2026/01/01", "April 15"]),
    ("calendar", "monday", ["0", "1"], ["2"]),
    ("calendar_dates", "exception_type", ["1", "2"], ["0"]),
    ("frequencies", "headway_secs", ["600"], ["0"]),
    ("transfers", "transfer_type", ["2"], ["4"]),
])
def test_gtfs_field_rules(spark, table, field, ok, bad):
    sch = schemas.GTFS[table]
    def filler(f):
        if f.type == "int":
            return "1"
        if f.pattern == schemas.GTFS_TIME:
            return "08:00:00"
        return "20260101" if f.pattern == schemas.GTFS_DATE else "X"

    base = {f.name: filler(f) for f in sch.fields if f.required}
    rows = []
    for i, v in enumerate(ok + bad):
        r = dict(base)
        r[field] = v
        r["row_num"] = i
        rows.append(r)
    cols = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows],
                               ", ".join(f"{c} {'bigint' if c == 'row_num' else 'string'}" for c in cols))
    good, bad_rows = sch.validate(df)
    assert sorted(r.row_num for r in good.collect()) == list(range(len(ok)))
    assert sorted(r.row_num for r in bad_rows.collect()) == list(range(len(ok), len(ok) + len(bad)))


def test_urn_and_names(spark):
    df = spark.createDataFrame([("Linha 1",), ("L1/A&B",), ("123",), ("",)], "x string")
    out = [r.u for r in df.select(S.build_urn("STCP", "Line", "x").alias("u")).collect()]
    assert out == ["PT:STCP:Line:Linha_1", "PT:STCP:Line:L1_A_B", "PT:STCP:Line:123", "PT:STCP:Line"]
    names = spark.createDataFrame([("  My--Project!!  ",), ("---",)], "x string")
    assert [r.s for r in names.select(S.safe_name("x").alias("s")).collect()] == ["my_project", ""]
    assert S.safe_name_text("  My--Project!!  ") == "my_project"


def test_codespace_rules():
    org = NX.Organisation("A", "A")
    for ok in ("980123456", "STCP"):
        NX.NetexConfig(ok, org, org)
    for bad in ("stcp", "ST CP", "PT-TEST", ""):
        with pytest.raises(ValueError):
            NX.NetexConfig(bad, org, org)
    assert NX.NetexConfig("FIXME", org, org).is_placeholder


def test_date_and_time_texts(spark):
    df = spark.createDataFrame([("2024-01-15",), ("20240115",), ("15/01/2024",), ("",), ("invalid",)], "d string")
    assert [r.x for r in df.select(S.to_yyyymmdd("d").alias("x")).collect()] == ["20240115"] * 3 + [None, None]
    t = spark.createDataFrame([("08:30:00",), ("25:00:00",)], "t string")
    assert [r.s for r in t.select(S.time_to_seconds("t").alias("s")).collect()] == [30600, 90000]
    s = spark.createDataFrame([(30600,)], "s int")
    assert s.select(S.seconds_to_time("s").alias("t")).first().t == "08:30:00"
    v = spark.createDataFrame([("20240229",), ("20230229",), ("00000101",), ("2024011",)], "d string")
    assert [r.ok for r in v.select(S.is_valid_yyyymmdd("d").alias("ok")).collect()] == [True, False, False, False]


# --- §1 Silver inputs -------------------------------------------------------------------------

def _operations(spark):
    rows = []
    for i, (line, stop, start, dwell) in enumerate([
        ("L001", "S001", "05:30:00", "25"), ("L001", "S002", "05:30:00", "25"), ("L001", "S003", "05:30:00", "25"),
        ("L002", "S004", "05:00:00", "30"), ("L002", "S005", "05:00:00", "30"), ("L002", "S006", "05:00:00", "30")]):
        rows.append((FEED, i, line, 0, stop, (i % 3) + 1, start, dwell, line))
    return spark.createDataFrame(rows, "feed_id string, row_num long, line_id string, direction_id int, stop_id string, "
                                       "stop_sequence int, service_start_time string, average_dwell_time string, "
                                       "operating_lines string")


def test_mapper_trips_and_interpolated_stop_times(spark):
    ops = _operations(spark)
    trips = mapping.map_trips(ops, ["row_num"])
    assert _rows(trips, "trip_id", "route_id") == [("L001_0_0001", "L001"), ("L002_0_0002", "L002")]
    st = mapping.map_stop_times(ops, trips, ["row_num"]).where(F.col("trip_id") == "L001_0_0001")
    assert _rows(st, "stop_sequence", "arrival_time", "departure_time") == [
        (1, "05:30:00", "05:30:25"), (2, "05:32:25", "05:32:50"), (3, "05:34:50", "05:35:15")]


def test_fleet_capacity_and_agency(spark):
    fleet = spark.createDataFrame(
        [(FEED, i, "Empresa Brasiliense de Transportes", s, t, f"Model {i}") for i, (s, t) in
         enumerate([(30, 60), (40, 80), (35, 70), (45, 70)])],
        "feed_id string, row_num int, owner_operator string, seated_capacity int, total_capacity int, "
        "manufacturer_model string")
    cap = mapping.fleet_capacity(fleet, ["row_num"]).first()
    assert (cap.seated_capacity, cap.standing_capacity, cap.vehicle_description) == (37, 33, "Model 0")
    ag = mapping.map_agency(fleet).first()
    assert ag.agency_id == "EMPRESA_BRASILIENSE_DE_TRANSPORTES"


def test_weather_as_of_forward_with_fallback(spark):
    day = dt.datetime(2024, 1, 15)
    obs = [(FEED, day.replace(hour=h), float(h), 0.0) for h in (6, 7, 8, 12, 18)]
    weather = spark.createDataFrame(obs, "feed_id string, timestamp timestamp_ntz, temperature_celsius double, "
                                         "precipitation_mm double")
    cases = {1: day.replace(hour=7, minute=30), 2: day.replace(hour=19), 3: day.replace(hour=5),
             4: day.replace(hour=8), 5: day - dt.timedelta(days=3), 6: day + dt.timedelta(days=2)}
    p = spark.createDataFrame([(FEED, k, v) for k, v in cases.items()], "feed_id string, row_num int, timestamp timestamp_ntz")
    out = dict((r.row_num, r.temperature_celsius) for r in FE.with_weather(p, "timestamp", weather).collect())
    assert out == {1: 8.0, 2: 18.0, 3: 6.0, 4: 8.0, 5: 6.0, 6: 18.0}


def test_hour_of_day_null_at_midnight_and_demand(spark):
    ts = [dt.datetime(2024, 1, 15, 0, 0, 30), dt.datetime(2024, 1, 15, 0, 1), dt.datetime(2024, 1, 13, 9)]
    p = spark.createDataFrame([(FEED, i, t, "L1", v) for i, (t, v) in enumerate(zip(ts, [3.9, None, 2.0]))],
                              "feed_id string, row_num int, timestamp timestamp_ntz, line_id string, "
                              "number_of_validations double")
    holidays = spark.createDataFrame([(FEED, dt.date(2024, 1, 15), "holiday"), (FEED, dt.date(2024, 1, 13), "strike")],
                                     "feed_id string, event_date date, event_type string")
    good, bad = FE.mode_a_samples(p, None, holidays)
    rows = {r.row_num: r for r in good.collect()}
    assert bad.count() == 0
    assert rows[0].hour_of_day is None and rows[1].hour_of_day == 0
    assert [rows[i].demand for i in range(3)] == [3, 0, 2]
    assert rows[0].day_type == "sunday_holiday" and rows[2].day_type == "saturday" and not rows[2].is_holiday


# --- §2 GTFS feeds -------------------------------------------------------------------------------

def _minimal_feed(spark, feed=FEED):
    def df(rows, schema):
        return spark.createDataFrame([(feed, i, *r) for i, r in enumerate(rows)], f"feed_id string, row_num long, {schema}")

    return {
        "agency": df([("A1", "Agency", "https://a.example", "Europe/Lisbon")],
                     "agency_id string, agency_name string, agency_url string, agency_timezone string"),
        "stops": df([("S1", "One", "41.15", "-8.61"), ("S2", "Two", "41.16", "-8.62")],
                    "stop_id string, stop_name string, stop_lat string, stop_lon string"),
        "routes": df([("R1", "A1", "1", "3")], "route_id string, agency_id string, route_short_name string, route_type string"),
        "calendar": df([("WD", "1", "1", "1", "1", "1", "0", "0", "20260101", "20261231")],
                       "service_id string, monday string, tuesday string, wednesday string, thursday string, "
                       "friday string, saturday string, sunday string, start_date string, end_date string"),
        "trips": df([("R1", "WD", "T1", "0")], "route_id string, service_id string, trip_id string, direction_id string"),
        "stop_times": df([("T1", "S1", "0", "08:00:00", "08:01:00"), ("T1", "S2", "1", "08:10:00", "08:11:00")],
                         "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string"),
    }


def test_minimal_feed_store_completeness_and_integrity(spark, scratch):
    st = store.GtfsStore(spark, f"{scratch}/store")
    rejected = st.load(_minimal_feed(spark), mode="replace")
    assert sum(df.count() for df in rejected.values()) == 0
    counts = st.counts()
    assert quality.completeness(counts).first().score == 60.0
    assert counts.where(F.col("records") == 0).count() == 9
    assert joins.fk_orphans(st.tables(), catalog.FK_EDGES).count() == 0


def test_bad_row_isolated_and_children_of_rejected_parents(spark, scratch):
    feed = _minimal_feed(spark)
    feed["routes"] = spark.createDataFrame(
        [(FEED, 0, "R1", "A1", "3"), (FEED, 1, "R2", "A1", "not_an_int")],
        "feed_id string, row_num long, route_id string, agency_id string, route_type string")
    feed["trips"] = spark.createDataFrame(
        [(FEED, 0, "R1", "WD", "T1"), (FEED, 1, "R2", "WD", "T2"), (FEED, 2, "GHOST_ROUTE", "WD", "T3")],
        "feed_id string, row_num long, route_id string, service_id string, trip_id string")
    st = store.GtfsStore(spark, f"{scratch}/store")
    rejected = st.load(feed, mode="replace")
    assert rejected["routes"].count() == 1
    assert _rows(rejected["trips"], "row_num") == [(1,), (2,)]
    assert _rows(st.read("trips"), "trip_id") == [("T1",)]


def test_merge_partial_upsert(spark, scratch):
    st = store.GtfsStore(spark, f"{scratch}/store")
    st.load(_minimal_feed(spark), mode="replace")
    stops = spark.createDataFrame([(FEED, 0, "S1", "Renamed", "41.15", "-8.61"), (FEED, 1, "S3", "Three", "41.2", "-8.6")],
                                  "feed_id string, row_num long, stop_id string, stop_name string, stop_lat string, "
                                  "stop_lon string")
    st.load({"stops": stops}, mode="merge_partial")
    assert _rows(st.read("stops"), "stop_id", "stop_name") == [("S1", "Renamed"), ("S2", "Two"), ("S3", "Three")]
    assert st.read("stop_times").count() == 2


def test_upsert_last_wins_and_null_keys(spark):
    old = spark.createDataFrame([(FEED, "T1", "2024-01-01", "a"), (FEED, "T2", None, "b")],
                                "feed_id string, trip_id string, service_date string, v string")
    new = spark.createDataFrame([(FEED, "T1", "2024-01-01", "x", 1), (FEED, "T1", "2024-01-01", "y", 2),
                                 (FEED, "T2", None, "c", 3)],
                                "feed_id string, trip_id string, service_date string, v string, row_num int")
    out = joins.upsert(old, new, ["trip_id", "service_date"], ["row_num"])
    assert _rows(out, "trip_id", "v") == [("T1", "y"), ("T2", "b"), ("T2", "c")]
    eq = joins.upsert(old, new, ["trip_id", "service_date"], ["row_num"], null_keys="equal")
    assert _rows(eq, "trip_id", "v") == [("T1", "y"), ("T2", "c")]


def test_delete_by_composite_key_text(spark):
    st = spark.createDataFrame([(FEED, "T1", 1), (FEED, "T1", 2), (FEED, "T2", 1)],
                               "feed_id string, trip_id string, stop_sequence int")
    keys = joins.split_key_text(spark.createDataFrame([(FEED, "T1|2")], "feed_id string, k string"), "k",
                                ["trip_id", "stop_sequence"], {"trip_id": "string", "stop_sequence": "int"})
    remaining, deleted = joins.delete_keys(st, keys, ["trip_id", "stop_sequence"])
    assert remaining.count() == 2 and deleted.count() == 1


def test_validator_finds_seeded_faults(spark):
    def raw(rows, schema):
        return spark.createDataFrame([(FEED, i, *r) for i, r in enumerate(rows)], f"feed_id string, row_num long, {schema}")

    tables = {
        "routes.txt": raw([("R1", "3", "#FFF"), ("R2", "bus", None), ("R3", "99", None)],
                          "route_id string, route_type string, route_color string"),
        "trips.txt": raw([("R1", "WD", "T1"), ("RX", "NOPE", "T2"), ("R1", "WD", "T1")],
                         "route_id string, service_id string, trip_id string"),
        "stops.txt": raw([("S1", "95.0", "-8"), ("S2", "abc", "-8")], "stop_id string, stop_lat string, stop_lon string"),
        "calendar.txt": raw([("WD", "20261231", "20260101")], "service_id string, start_date string, end_date string"),
        "stop_times.txt": raw([("T1", "S1", "2", "8:00"), ("T1", "S2", "1", "08:10:00")],
                              "trip_id string, stop_id string, stop_sequence string, arrival_time string"),
    }
    issues = V.validate_feed(tables)
    msgs = [r.message for r in issues.collect()]
    for expect in ["route_color '#FFF' is not a 6-digit hex string", "route_type 'bus' is not an integer",
                   "route_type 99 is not a standard value", "route_id 'RX' not found in routes.txt",
                   "service_id 'NOPE' not found in calendar(_dates).txt", "stop_lat 95.0 is outside [-90, 90]",
                   "stop_lat 'abc' is not numeric", "start_date '20261231' is after end_date '20260101'",
                   "arrival_time '8:00' does not match HH:MM:SS",
                   "trip_id 'T1' stop_sequence must strictly increase (saw 2 then 1)",
                   "Duplicate primary key ['trip_id']=['T1'] (also at row 0)"]:
        assert expect in msgs, expect
    summary = V.issue_summary(issues).first()
    assert summary.quality_tag == "draft" and not summary.is_valid


def _netex_feed(spark):
    def df(rows, schema):
        return spark.createDataFrame([(FEED, i, *r) for i, r in enumerate(rows)], f"feed_id string, row_num long, {schema}")

    return {
        "stops": df([("STATION_1", "Central Station", 41.44, -8.29, 1, None), ("QUAY_A", "Platform A", 41.44, -8.291, 0,
                     "STATION_1"), ("ORPHAN", "Mercado", 41.45, -8.30, 0, None)],
                    "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, "
                    "parent_station string"),
        "routes": df([("R1", "G", "1", "Centro - Aeroporto", 3), ("R2", "G", "N1", "Noite", 3)],
                     "route_id string, agency_id string, route_short_name string, route_long_name string, route_type int"),
        "trips": df([("R1", "WK", "T1", 0), ("R2", "WK", "T_NIGHT", 0)],
                    "route_id string, service_id string, trip_id string, direction_id int"),
        "stop_times": df([("T1", "QUAY_A", 1, "08:00:00", "08:00:00"), ("T1", "ORPHAN", 2, "08:15:00", "08:15:00"),
                          ("T_NIGHT", "QUAY_A", 1, "23:50:00", "23:50:00"), ("T_NIGHT", "ORPHAN", 2, "25:10:00", "25:10:00")],
                         "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string"),
        "calendar": df([("WK", 1, 1, 1, 1, 1, 0, 0, dt.date(2026, 1, 1), dt.date(2026, 12, 31))],
                       "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, "
                       "saturday int, sunday int, start_date date, end_date date"),
        "calendar_dates": df([("WK", dt.date(2026, 5, 1), 2)], "service_id string, date date, exception_type int"),
    }


CFG = NX.NetexConfig("GUIMABUS", NX.Organisation("CIM_AVE", "CIM do Ave"), NX.Organisation("GUIMABUS", "Guimabus"))


def test_netex_translation_of_the_seed_feed(spark):
    f = _netex_feed(spark)
    modes = NX.stop_modes(f["routes"], f["trips"], f["stop_times"], ["row_num"])
    places = NX.stop_places(f["stops"], modes, CFG, ["row_num"])
    got = {r.place_key: ([q.id for q in r.quays], r.transport_mode) for r in places.collect()}
    assert got == {"STATION_1": (["PT:GUIMABUS:Quay:QUAY_A"], "bus"), "ORPHAN_place": (["PT:GUIMABUS:Quay:ORPHAN"], "bus")}
    pats, t2p = NX.journey_patterns(f["trips"], f["stop_times"], CFG, ["row_num"], ["row_num"])
    assert _rows(pats, "local_id") == [("R1_0_1",), ("R2_0_2",)]
    pt = NX.passing_times(f["stop_times"], t2p, CFG, ["row_num"]).where(F.col("trip_id") == "T_NIGHT")
    assert _rows(pt, "idx", "arrival_time", "arrival_day_offset") == [(1, "23:50:00", 0), (2, "01:10:00", 1)]
    day_types, periods, assignments = NX.calendar_fold(f["calendar"], f["calendar_dates"], CFG, ["row_num"], ["row_num"])
    assert _rows(assignments, "order", "date", "is_available") == [(1, None, True), (2, "2026-05-01", False)]
    v = NX.validity(periods).first()
    assert (v.from_date, v.to_date) == ("2026-01-01", "2026-12-31")
    assert day_types.first().days_of_week == "Monday Tuesday Wednesday Thursday Friday"


def test_active_dates_and_restriction(spark):
    f = _netex_feed(spark)
    active = service.active_service_dates(f["calendar"], f["calendar_dates"])
    dates = {r.date for r in active.collect()}
    assert dt.date(2026, 5, 1) not in dates and dt.date(2026, 5, 4) in dates and dt.date(2026, 5, 2) not in dates
    sub = service.restrict_to_routes(f, spark.createDataFrame([(FEED, "R2")], "feed_id string, route_id string"))
    assert _rows(sub["trips"], "trip_id") == [("T_NIGHT",)]
    assert _rows(sub["stops"], "stop_id") == [("ORPHAN",), ("QUAY_A",), ("STATION_1",)]


def test_netex_export_documents_are_well_formed(spark, scratch):
    import glob
    import xml.etree.ElementTree as ET

    from railyard.sinks import netex_xml

    f = _netex_feed(spark)
    f["agency"] = spark.createDataFrame([(FEED, 0, "GUIMABUS", "Guimabus", "info@guimabus.pt")],
                                        "feed_id string, row_num long, agency_id string, agency_name string, "
                                        "agency_email string")
    out = f"{scratch}/netex"
    issues, docs = netex_xml.export_netex(f, CFG, out, "2026-04-21T08:55:45Z")
    assert issues.where("severity = 'error'").count() == 0
    names = sorted(r.document for r in docs.collect())
    assert names == ["ServiceFrame_Lines", "SiteFrame_Stops", "TimetableFrame_Schedules_Line_R1",
                     "TimetableFrame_Schedules_Line_R2"]
    ns = {"n": "http://www.netex.org.uk/netex"}
    parsed = {}
    for name in names:
        files = sorted(glob.glob(f"{out}/feed_id={FEED}/document={name}/part-*.txt"))  # parts in the order of their names
        parsed[name] = ET.fromstring("".join(open(p, encoding="utf-8").read() for p in files).encode("utf-8"))
        assert parsed[name].get("{http://www.w3.org/2001/XMLSchema-instance}schemaLocation").endswith("NeTEx_publication.xsd")
    night = parsed["TimetableFrame_Schedules_Line_R2"]
    offsets = [e.text for e in night.iter("{http://www.netex.org.uk/netex}ArrivalDayOffset")]
    assert offsets == ["1"]
    times = [e.text for e in night.iter("{http://www.netex.org.uk/netex}ArrivalTime")]
    assert times == ["23:50:00", "01:10:00"]
    stops = parsed["SiteFrame_Stops"]
    station = stops.find(".//n:StopPlace[@id='PT:GUIMABUS:StopPlace:STATION_1']", ns)
    assert [q.get("id") for q in station.findall(".//n:Quay", ns)] == ["PT:GUIMABUS:Quay:QUAY_A"]
    orders = [e.find("n:Order", ns).text for e in stops.iter("{http://www.netex.org.uk/netex}DayTypeAssignment")]
    assert orders == ["1", "2"]
    lines = parsed["ServiceFrame_Lines"]
    assert [p.get("id") for p in lines.iter("{http://www.netex.org.uk/netex}ServiceJourneyPattern")] == [
        "PT:GUIMABUS:JourneyPattern:R1_0_1", "PT:GUIMABUS:JourneyPattern:R2_0_2"]
    assert lines.find(".//n:ValidBetween/n:FromDate", ns).text == "2026-01-01T00:00:00"


def test_feed_gate_error_samples_and_clear(spark):
    f = _netex_feed(spark)
    other = spark.createDataFrame([("G", 0, "X", "x", 1.0, 1.0, 0, None)], f["stops"].schema)
    tables = {**f, "stops": f["stops"].unionByName(other),
              "agency": spark.createDataFrame([(FEED, 0, "G", "G")], "feed_id string, row_num long, agency_id string, "
                                                                      "agency_name string")}
    gated = store.feed_from_store(tables)
    assert {r.feed_id for r in gated["stops"].collect()} == {FEED}  # feed G has no routes/trips
    rej = {"trips": spark.createDataFrame([(FEED, i, f"e{i}") for i in range(70)],
                                          "feed_id string, row_num long, error string")}
    samples = store.error_samples(rej, 50)
    assert samples.count() == 50 and samples.agg(F.max("row_num")).first()[0] == 49
    keep, deleted = store.clear_tables(tables, spark.createDataFrame([(FEED,)], "feed_id string"), ["stops", "trips"])
    assert keep["stops"].count() == 1
    assert {(r.table_name, r.deleted) for r in deleted.collect()} == {("stops", 3), ("trips", 2)}
