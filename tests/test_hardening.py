"""Store safety, multi-feed files, skew, odd values."""

from __future__ import annotations

import bisect
import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from test_sources import MINIMAL, _zip

from railyard.functions import scalars as S
from railyard.operators import joins, store, validate
from railyard.schema import Field, Schema
from railyard.sinks import gtfs_text, netex_xml
from railyard.sources import archive, geojson, tabular


def _import(spark, folder, root, feeds, mode="merge", **more):
    os.makedirs(folder)
    for name, members in feeds.items():
        _zip(f"{folder}/{name}.zip", members)
    st = store.GtfsStore(spark, root)
    st.import_rows(archive.scan_archives(spark, folder), mode, **more)
    return st


def _files(root):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/**/part-*", recursive=True)}


def test_merge_touches_only_its_feeds_and_replays_change_nothing(spark, scratch):
    root = f"{scratch}/store"
    info = "feed_publisher_name,feed_publisher_url,feed_lang\nP,https://p.example,pt\n"
    feed = {**MINIMAL, "feed_info.txt": info}
    st = _import(spark, f"{scratch}/a", root, {"A": feed, "B": feed})
    before = _files(root)
    _import(spark, f"{scratch}/b", root, {"A": {"stops.txt": "stop_id,stop_name\nS1,Renamed\n", "feed_info.txt": info}}, "merge_partial", batch_id="second")
    after = _files(root)
    assert {p for p in before if "feed_id=B" in p} == {p for p in after if "feed_id=B" in p and before.get(p) == after[p]}
    rows = lambda: {t: sorted(map(str, st.read(t).collect())) for t in ("stops", "feed_info", "stop_times")}
    once = rows()
    assert sorted((r.feed_id, r.stop_name) for r in st.read("stops").collect() if r.stop_id == "S1") == [("A", "Renamed"), ("B", "One")]
    assert [r.feed_id for r in st.read("feed_info").collect()].count("A") == 2  # a table without key keeps every batch
    _import(spark, f"{scratch}/c", root, {"A": {"stops.txt": "stop_id,stop_name\nS1,Renamed\n", "feed_info.txt": info}}, "merge_partial", batch_id="second")
    assert rows() == once


def test_replace_wipes_previous_and_reports_the_outcome(spark, scratch):
    root = f"{scratch}/store"
    _import(spark, f"{scratch}/a", root, {"A": {**MINIMAL, "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nX,1,2,0\n"}})
    bad = MINIMAL["stops.txt"] + "S3,Three,999,0\n"
    st = _import(spark, f"{scratch}/b", root, {"A": {**MINIMAL, "stops.txt": bad}}, "replace")
    assert st.read("shapes").count() == 0 and st.read("stops").count() == 2
    got = {r.table_name: (r.stored, r.failed, r.cleared, r.skipped) for r in st.outcome.collect()}
    assert got["stops"] == (2, 1, 2, False) and got["shapes"] == (0, 0, 1, True) and len(got) == 15


def test_read_errors_of_the_store_rise(spark, scratch):
    root = f"{scratch}/store"
    st = _import(spark, f"{scratch}/a", root, {"A": MINIMAL})
    for p in glob.glob(f"{root}/stops/**/part-*", recursive=True):
        with open(p, "wb") as fh:
            fh.write(b"damaged")
    with pytest.raises(Exception):
        _import(spark, f"{scratch}/b", root, {"A": {"stops.txt": "stop_id\nS9\n"}}, "merge_partial")
    assert st.read("trips").count() == 1


def test_delete_by_key(spark, scratch):
    st = _import(spark, f"{scratch}/a", f"{scratch}/store", {"A": MINIMAL, "B": MINIMAL})
    keys = spark.createDataFrame([("A", "T1", 0), ("A", "T1", 1), ("A", "nope", 1)], "feed_id string, trip_id string, stop_sequence long")
    assert [(r.feed_id, r.deleted) for r in st.delete("stop_times", keys).collect()] == [("A", 2)]
    assert sorted(r.feed_id for r in st.read("stop_times").collect()) == ["B", "B"]


def test_feeds_with_different_columns_validate_clean(spark, scratch):
    other = {**MINIMAL, "stops.txt": "stop_id,stop_name,zone_id,stop_lon,stop_lat\nS1,\"One, two\",Z9,-8.61,41.15\nS2,\"line\nbreak\",Z9,0.0001,-0.0005\n"}
    st = _import(spark, f"{scratch}/in", f"{scratch}/store", {"A": MINIMAL, "B": other})
    out = f"{scratch}/out"
    gtfs_text.export_feed(st.tables(), out)
    text = "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{out}/feed_id=B/table=stops/part-*")))
    assert text.startswith("stop_id,stop_name,stop_lat,stop_lon,zone_id\r\n") and "-0.0005,0.0001" in text and "E-" not in text
    issues = validate.validate_text_export(spark, out)
    assert [r.message for r in issues.where("severity = 'error'").collect()] == []


def test_large_members_are_parts_of_one_file(spark, scratch):
    rows = spark.range(5000).select(F.lit("A").alias("feed_id"), F.col("id").cast("string").alias("stop_id"), F.concat(F.lit("n"), "id").alias("stop_name"))
    out = f"{scratch}/out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gtfs_text.write_feed({"stops": rows}, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(f"{out}/feed_id=A/table=stops/part-*")) > 3
    back = tabular.read_csv_text(spark, f"{out}/feed_id=*/table=stops", parts=True)
    assert sorted((r.stop_id, r.stop_name) for r in back.collect()) == sorted((str(i), f"n{i}") for i in range(5000))
    assert sorted(r.row_num for r in back.collect()) == list(range(5000))


def test_csv_records_headers_and_batches(spark, scratch):
    d = f"{scratch}/batch"
    os.makedirs(d)
    for name, text in {"stops.txt": "stop_id,stop_name\nS1,\"a\nb\"\nS2,x\n", "more_stops.csv": "stop_name,stop_id\ny,S3\n", "trips.txt": "trip_id,route_id,service_id\nT,R,W\n", "note.txt": "q\n1\n"}.items():
        with open(f"{d}/{name}", "w") as fh:
            fh.write(text)
    pv = {r.file_name: (r.data_rows, r.problems) for r in tabular.batch_preview(spark, d).collect()}
    assert pv["stops.txt"] == (2, []) and pv["note.txt"] == (1, ["unknown table"])
    assert {r.problems[-1] for r in tabular.batch_preview(spark, d, max_files=2).collect()} == {"more than 2 files"}
    tables = tabular.load_batch(spark, d, "F", overrides={"more_stops.csv": "stops"})
    assert sorted((r.stop_id, r.stop_name) for r in tables["stops"].collect()) == [("S1", "a\nb"), ("S2", "x"), ("S3", "y")]
    assert sorted(tables) == ["stops", "trips"]


def test_archives_are_refused_by_size_only_if_asked(spark, scratch):
    os.makedirs(f"{scratch}/z")
    _zip(f"{scratch}/z/A.zip", {**MINIMAL, **{f"x{i}.txt": "a\n" for i in range(60)}})
    assert archive.rejects(archive.scan_archives(spark, f"{scratch}/z")).count() == 0
    refused = archive.rejects(archive.scan_archives(spark, f"{scratch}/z", limits=archive.Limits(members=50))).collect()
    assert [r.reject for r in refused] == ["Archive has 66 members (max 50)"]


@pytest.mark.parametrize("spread", [1, 86_400])
def test_as_of_join_with_a_busy_day_and_instant(spark, spread):
    rng = random.Random(spread)
    at = lambda s: dt.datetime(2024, 5, 1) + dt.timedelta(seconds=s)
    left = [("A" if i % 9 else "B", i, at(rng.randrange(0, 50) * spread) if i % 3 else at(7 * spread)) for i in range(2000)] + [("A", -1, None), ("C", -2, at(1))]
    right = [("A", at(rng.randrange(5, 40) * spread), float(i)) for i in range(300)] + [("B", at(3 * spread), -1.0)]
    got = joins.as_of_forward(spark.createDataFrame(left, "feed_id string, row_num long, ts timestamp_ntz"),
                              spark.createDataFrame(right, "feed_id string, ts timestamp_ntz, v double"), "ts", ["v"])
    best = {}
    for f, t, v in right:
        best.setdefault(f, {})
        best[f][t] = min(v, best[f].get(t, v))
    for r in got.collect():
        times = sorted(best.get(r.feed_id, {}))
        i = bisect.bisect_left(times, r.ts) if r.ts else len(times)
        assert r.v == (best[r.feed_id][times[min(i, len(times) - 1)]] if times else None)
    assert got.count() == len(left)


def test_numbers_are_exact_and_strict(spark):
    values = ["9007199254740993", "1.0", "12d", "1f", "-5", "1e3", " 7 ", "99999999999999999999", None]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "row_num long, a string, b string")
    good, bad = Schema("t", (Field("a", "int"), Field("b", "str"))).validate(df, keep=["row_num"])
    assert sorted((r.b, r.a) for r in good.collect() if r.b) == [(" 7 ", 7), ("-5", -5), ("1.0", 1), ("9007199254740993", 9007199254740993)]
    good, _ = Schema("t", (Field("a", "float"),)).validate(df, keep=["row_num"])
    assert sorted(r.a for r in good.collect() if r.a is not None) == [-5.0, 1.0, 7.0, 1000.0, 9007199254740992.0, 1e20]
    floats = spark.createDataFrame([(0.0001,), (-0.0005,), (12345678.5,), (3.0,), (1e20,), (float("nan"),), (None,)], "x double")
    assert [r.t for r in floats.select(S.format_cell("x", True).alias("t")).collect()] == ["0.0001", "-0.0005", "12345678.5", "3", "100000000000000000000", "", ""]


def test_blank_ids_and_huge_route_types_are_reported(spark):
    trips = spark.createDataFrame([("F", 0, " "), ("F", 1, ""), ("F", 2, None)], "feed_id string, row_num long, route_id string")
    routes = spark.createDataFrame([("F", 0, "3000000000"), ("F", 1, "3")], "feed_id string, row_num long, route_type string")
    parents = spark.createDataFrame([("F", "R1")], "feed_id string, route_id string")
    bad = joins.missing_references(trips, "route_id", [(parents, "route_id")], "trips.txt", "row_num", "'%s' not found")
    assert [r.message for r in bad.collect()] == ["' ' not found"]
    assert [r.message for r in validate.union_issues(validate.route_metadata(routes)).collect()] == ["route_type 3000000000 is not a standard value"]


def test_rings_that_cross_or_touch_themselves(spark):
    rings = {"square": [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], "bow_tie": [[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]],
             "spike": [[0, 0], [2, 0], [1, 0], [1, 2], [0, 0]], "concave": [[0, 0], [4, 0], [4, 4], [2, 1], [0, 4], [0, 0]]}
    df = spark.createDataFrame([(k, ("Polygon", str([r]))) for k, r in rings.items()], "k string, g struct<type:string,coordinates:string>")
    assert {r.k: r.v for r in df.select("k", geojson.geometry_valid(F.col("g")).alias("v")).collect()} == {
        "square": True, "bow_tie": False, "spike": False, "concave": True}


def test_netex_refuses_and_defaults(spark, scratch):
    from test_fixtures import CFG, FEED, _netex_feed

    f = _netex_feed(spark)
    f["agency"] = spark.createDataFrame([(FEED, 0, "X", "X")], "feed_id string, row_num long, agency_id string, agency_name string")
    none = f["calendar"].limit(0)
    rows = netex_xml.netex_documents({**f, "calendar": none}, CFG, "t").where("section = 0").collect()
    today = dt.date.today().isoformat()
    assert rows and all(r.text.startswith("<?xml") and f"<FromDate>{today}" in r.text for r in rows)
    odd = {**f, "routes": f["routes"].withColumn("route_type", F.lit(99))}
    issues, docs = netex_xml.export_netex(odd, CFG, f"{scratch}/n", "t")
    assert docs.count() == 0 and "unmapped route_type 99" in issues.where("severity = 'error'").first().message
    issues, docs = netex_xml.export_netex(f, netex_xml.NetexConfig("FIXME", CFG.authority, CFG.operator), f"{scratch}/p", "t")
    assert docs.count() == 0 and issues.where("message like '%placeholder%'").count() == 1


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.lit("v").alias("v"))
    want = [r.k for r in store.page(df, ["k"], 20, 300).collect()]
    monkeypatch.setattr(store, "TOP_K_ROWS", 10)
    assert [r.k for r in store.page(df, ["k"], 20, 300).collect()] == want == list(range(300, 320))
