"""Archive, CSV upload, GeoJSON and text-export tests (inputs written by the tests)."""

from __future__ import annotations

import glob
import json
import os
import zipfile

from pyspark.sql import functions as F

from railyard import catalog
from railyard.operators import store
from railyard.sinks import gtfs_text, layers
from railyard.sources import archive, geojson, tabular
from railyard import schemas

MINIMAL = {
    "agency.txt": "agency_id,agency_name,agency_url,agency_timezone\r\nA1,Agency,https://a.example,Europe/Lisbon\r\n",
    "stops.txt": "﻿stop_id, stop_name ,stop_lat,stop_lon\nS1, One ,41.15,-8.61\nS2,Two,41.16,-8.62\n",
    "routes.txt": "route_id,agency_id,route_short_name,route_type\nR1,A1,1,3\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
                    "WD,1,1,1,1,1,0,0,20260101,20261231\n",
    "trips.txt": "route_id,service_id,trip_id,direction_id\nR1,WD,T1,0\n",
    "stop_times.txt": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\n"
                      "T1,S1,0,08:00:00,08:01:00\nT1,S2,1,08:10:00,08:11:00\n",
}


def _zip(path: str, members: dict[str, str], prefix: str = "") -> None:
    with zipfile.ZipFile(path, "w") as zf:
        for name, text in members.items():
            zf.writestr(prefix + name, text)


def test_archive_preview_variants(spark, scratch):
    d = f"{scratch}/zips"
    os.makedirs(d)
    _zip(f"{d}/ok.zip", MINIMAL)
    _zip(f"{d}/nested.zip", MINIMAL, prefix="feed/")
    _zip(f"{d}/extra.zip", {**MINIMAL, "notes.txt": "x\n1\n"})
    _zip(f"{d}/nostops.zip", {k: v for k, v in MINIMAL.items() if k != "stops.txt"})
    with open(f"{d}/broken.zip", "wb") as fh:
        fh.write(b"not a zip at all")
    rows = archive.scan_archives(spark, d)
    pv = {r.feed_id: r for r in archive.preview(rows).collect()}
    assert pv["ok"].is_valid and pv["ok"].tables["stop_times"] == 2 and pv["ok"].tables["stops"] == 2
    assert pv["nested"].is_valid
    assert pv["extra"].unknown_files == ["notes.txt"] and pv["extra"].is_valid
    assert not pv["nostops"].is_valid and pv["nostops"].missing_required == ["stops.txt"]
    assert not pv["broken"].is_valid and pv["broken"].rejects == ["Not a valid ZIP archive"]
    stops = archive.table_rows(rows, "stops").where(F.col("feed_id") == "ok")
    got = sorted((r.stop_id, r.stop_name) for r in stops.collect())
    assert got == [("S1", "One"), ("S2", "Two")]  # BOM stripped, keys and values trimmed


def test_round_trip_export_import(spark, scratch):
    d = f"{scratch}/in"
    os.makedirs(d)
    _zip(f"{d}/feedA.zip", MINIMAL)
    st = store.GtfsStore(spark, f"{scratch}/store")
    gate, rejected = st.import_archives(d, "replace")
    assert gate.where(F.col("reject_reason").isNotNull()).count() == 0
    assert sum(df.count() for df in rejected.values()) == 0
    out = f"{scratch}/export"
    issues, completeness, summary = gtfs_text.export_feed(st.tables(), out)
    assert issues.where(F.col("severity") == "error").count() == 0
    assert completeness.first().score == 60.0
    files = sorted(glob.glob(f"{out}/feed_id=feedA/table=*/part-*.txt"))
    assert len(files) == 6  # empty tables give no file
    text = open(glob.glob(f"{out}/feed_id=feedA/table=stops/part-*.txt")[0], newline="").read()
    assert text.startswith("stop_id,stop_name,stop_lat,stop_lon\r\n") and "None" not in text
    assert "41.15" in text
    from railyard.operators import validate as V

    issues = V.validate_text_export(spark, out)
    assert issues.where(F.col("severity") == "error").count() == 0
    # zip the export back and import it again: same tables
    members = {}
    for f in files:
        table = f.split("table=")[1].split("/")[0]
        members[f"{table}.txt"] = open(f, newline="").read()
    d2 = f"{scratch}/again"
    os.makedirs(d2)
    _zip(f"{d2}/feedA.zip", members)
    st2 = store.GtfsStore(spark, f"{scratch}/store2")
    st2.import_archives(d2, "replace")
    for t in ("stops", "stop_times", "trips"):
        a = sorted(tuple(r) for r in st.read(t).collect())
        b = sorted(tuple(r) for r in st2.read(t).collect())
        assert a == b, t


def test_csv_upload_line_numbers_and_aliases(spark, scratch):
    p = f"{scratch}/energy.csv"
    with open(p, "w") as fh:
        fh.write("Average Consumption / Vehicle,Energy Cons per Pax-km,Average CO2 Emissions,Operational Status\n")
        fh.write("1.5,0.2,3.0,true\n")
        fh.write("N/A,0.2,3.0,yes\n")
        fh.write("-1,0.2,3.0,no\n")
    df = tabular.read_csv_text(spark, p)
    good, bad, missing = tabular.validate_upload(
        df, schemas.UPLOADS["Fleet Energy Performance"],
        aliases={"Average Consumption / Vehicle": "avg_consumption_per_vehicle"})
    assert missing == []
    assert good.count() == 1
    errs = sorted((r.line, r.message) for r in bad.collect())
    assert errs == [(3, "avg_consumption_per_vehicle: Field required"),
                    (4, "avg_consumption_per_vehicle: Input should be greater than or equal to 0")]


def test_relaxed_upload_keeps_mandatory_ranges_only(spark, scratch):
    p = f"{scratch}/stops.csv"
    with open(p, "w") as fh:
        fh.write("stop_id,latitude,longitude,zone_type,num_lines_served\n")
        fh.write("S1,41.1,-500,downtown,0\n")   # relaxed: longitude/zone/lines lose checks
        fh.write("S2,95,-8.6,urban,2\n")        # latitude mandatory: keeps its range
    df = tabular.read_csv_text(spark, p)
    good, bad, missing = tabular.validate_upload(df, schemas.UPLOADS["Stop Spatial Features"],
                                                 mandatory=["stop_id", "latitude", "elevation_m"])
    assert missing == ["elevation_m"]
    assert [r.stop_id for r in good.collect()] == ["S1"]
    assert [r.line for r in bad.collect()] == [3]


def test_geojson_validity_and_metrics(spark, scratch):
    feats = [
        {"type": "Feature", "properties": {"stop_id": "A"}, "geometry": {"type": "Point", "coordinates": [-8.6, 41.1]}},
        {"type": "Feature", "properties": {"stop_id": "B"}, "geometry": None},
        {"type": "Feature", "properties": {"stop_id": "C"}, "geometry": {"type": "Point", "coordinates": []}},
        {"type": "Feature", "properties": {"stop_id": "D"}, "geometry": {"type": "LineString", "coordinates": [[1, 2]]}},
        {"type": "Feature", "properties": {"stop_id": "E"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}},
        {"type": "Feature", "properties": {"stop_id": "F"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"stop_id": "G"},
         "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}},
    ]
    p = f"{scratch}/stops.geojson"
    with open(p, "w") as fh:
        json.dump({"type": "FeatureCollection", "features": feats}, fh)
    f = geojson.read_feature_collections(spark, p)
    valid, invalid = geojson.filter_valid(f)
    assert sorted(r.properties["stop_id"] for r in valid.collect()) == ["A", "F", "G"]
    counts = {r.geometry_type: r.features for r in geojson.geometry_metrics(f).collect()}
    assert counts == {"Point": 2, "null": 1, "LineString": 2, "Polygon": 2}
    v = geojson.validation_counts(f, ["stop_id", "name"]).first()
    assert (v.total, v.valid, v.invalid, v.missing_columns) == (7, 3, 4, ["name"])
    wkt = [r.w for r in valid.select(geojson.to_wkt(F.col("geometry")).alias("w")).collect()]
    assert "POINT (-8.6 41.1)" in wkt


def test_validation_report_and_layers(spark, scratch):
    good = spark.createDataFrame([(1,), (2,)], "x int")
    bad = spark.createDataFrame([(3,)], "x int")
    r = layers.validation_report(good, bad, "demo").first()
    assert (r.total, r.valid, r.invalid) == (3, 2, 1)
    path = layers.save_silver(good, scratch, "My Project", "r1", "Demo Set")
    assert path.endswith("project=my_project/run_id=r1/silver/demo_set")
    assert spark.read.parquet(path).count() == 2


def test_import_gate_modes(spark):
    feeds = spark.createDataFrame([("a", "replace", False), ("b", "merge_partial", False), ("c", "abort_if_not_empty", True),
                                   ("d", "merge", True)], "feed_id string, mode string, store_populated boolean")
    members = spark.createDataFrame([("a", t) for t in ("agency", "stops", "routes", "trips", "stop_times", "calendar")]
                                    + [("b", "stops"), ("c", "agency"), ("d", "stops")],
                                    "feed_id string, table_name string")
    g = {r.feed_id: r.reject_reason for r in store.import_gate(feeds, members).collect()}
    assert g["a"] is None
    assert g["b"].startswith("MERGE_PARTIAL requires")
    assert g["c"].startswith("Archive is missing required GTFS files: stops, routes")
    assert g["d"] == ("Archive is missing required GTFS files: agency, routes, trips, stop_times, "
                      "calendar_or_calendar_dates")
    assert set(catalog.REQUIRED_TABLES) <= set(catalog.TABLES)


def test_incremental_merge_stream(spark, scratch):
    from railyard.streaming.incremental import merge_archive_stream

    src = f"{scratch}/landing"
    os.makedirs(src)
    _zip(f"{src}/feedS.zip", MINIMAL)
    root = f"{scratch}/store"
    ckpt = f"{scratch}/stream-ckpt"
    merge_archive_stream(spark, src, root, mode="merge", checkpoint_location=ckpt).awaitTermination(600)
    st = store.GtfsStore(spark, root)
    assert sorted(r.stop_id for r in st.read("stops").collect()) == ["S1", "S2"]
    os.makedirs(f"{src}/later")
    _zip(f"{src}/later/feedS.zip", {"stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nS1,Renamed,41.15,-8.61\n"
                                                  "S3,Three,41.2,-8.6\n"})
    merge_archive_stream(spark, src, root, mode="merge_partial", checkpoint_location=ckpt).awaitTermination(600)
    got = sorted((r.stop_id, r.stop_name) for r in st.read("stops").collect())
    assert got == [("S1", "Renamed"), ("S2", "Two"), ("S3", "Three")]
    assert st.read("stop_times").count() == 2


def test_empty_member_warning(spark, scratch):
    from railyard.operators import validate as V

    d = f"{scratch}/empty"
    os.makedirs(d)
    _zip(f"{d}/e.zip", {**MINIMAL, "calendar_dates.txt": "service_id,date,exception_type\n"})
    rows = archive.scan_archives(spark, d, raw=True)
    w = [r.message for r in V.empty_file_warnings(rows).collect()]
    assert w == ["File 'calendar_dates.txt' has no data rows"]


def test_features_by_line_are_those_of_the_collection(spark, scratch):
    import json
    import os

    from railyard.sources import geojson

    made = [{"type": "Feature", "properties": {"n": i, "name": f"stop {i}"}, "geometry": {"type": "Point", "coordinates": [i, 1.5]}} for i in range(500)]
    os.makedirs(f"{scratch}/lines")
    with open(f"{scratch}/lines/a.json", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in made)
    with open(f"{scratch}/whole.json", "w") as f:
        json.dump({"type": "FeatureCollection", "features": made}, f)
    rows = lambda df: sorted((r.properties["name"], r.properties["n"], tuple(r.geometry)) for r in df.collect())
    lines = geojson.read_features(spark, f"{scratch}/lines")
    assert rows(lines) == rows(geojson.read_feature_collections(spark, f"{scratch}/whole.json")) and lines.count() == 500
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert geojson.read_features(spark, f"{scratch}/lines").rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
