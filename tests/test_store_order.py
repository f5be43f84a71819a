"""Stored row order, exports in it, and batches of tables without a key."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F
from test_hardening import _files, _import
from test_sources import MINIMAL

from railyard.operators import store, validate
from railyard.sinks import gtfs_text

INFO = "feed_publisher_name,feed_publisher_url,feed_lang\n"


def _stop_times(n: int) -> str:
    lines = ["trip_id,arrival_time,departure_time,stop_id,stop_sequence"]
    lines += [f"T1,{8 + k // 60:02}:{k % 60:02}:00,{8 + k // 60:02}:{k % 60:02}:00,S{1 + k % 2},{k}" for k in range(1, n + 1)]
    return "\n".join(lines) + "\n"


def _member(out: str, feed: str, table: str) -> list[str]:
    lines = []
    for f in sorted(glob.glob(f"{out}/feed_id={feed}/table={table}/part-*")):
        lines += open(f, newline="").read().split("\r\n")[:-1]
    return lines


def test_export_keeps_the_order_of_the_load(spark, scratch):
    stops = "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"{s},n{s},41.1,-8.6\n" for s in ("S2", "S10", "S1", "A9"))
    feed = {**MINIMAL, "stops.txt": stops, "stop_times.txt": _stop_times(120)}
    st = _import(spark, f"{scratch}/a", f"{scratch}/store", {"A": feed, "B": feed})
    out = f"{scratch}/out"
    gtfs_text.export_feed(st.tables(), out)
    for name in "AB":
        assert [x.split(",")[0] for x in _member(out, name, "stops")] == ["stop_id", "S2", "S10", "S1", "A9"]
        sequence = _member(out, name, "stop_times")[0].split(",").index("stop_sequence")
        assert [int(x.split(",")[sequence]) for x in _member(out, name, "stop_times")[1:]] == list(range(1, 121))
    assert store.ROW_ORDER not in "".join(_member(out, "A", "stops"))
    assert validate.validate_text_export(spark, out).where(F.col("severity") == "error").count() == 0
    # a replaced row moves to the end, as in a table whose rows are replaced
    _import(spark, f"{scratch}/b", f"{scratch}/store", {"A": {"stops.txt": "stop_id,stop_name\nS10,again\nZ1,new\n"}}, "merge_partial")
    gtfs_text.export_feed(st.tables(), f"{scratch}/out2")
    assert [x.split(",")[0] for x in _member(f"{scratch}/out2", "A", "stops")] == ["stop_id", "S2", "S1", "A9", "S10", "Z1"]
    assert [x.split(",")[0] for x in _member(f"{scratch}/out2", "B", "stops")] == ["stop_id", "S2", "S10", "S1", "A9"]
    assert [(r.feed_id, r.stop_id) for r in st.page("stops", 3, 1).collect()] == [("A", "S1"), ("A", "A9"), ("A", "S10")]


def test_tables_without_row_order_are_written_by_typed_keys(spark):
    rows = [("A", "T1", str(k), "S") for k in (1, 10, 11, 2, 9, 100)] + [("A", "T0", "x", "S"), ("A", "T0", None, "S")]
    df = spark.createDataFrame(rows, "feed_id string, trip_id string, stop_sequence string, stop_id string")
    expected = [("T0", ""), ("T0", "x"), *(("T1", str(k)) for k in (1, 2, 9, 10, 11, 100))]
    for frame in (df, df.where("trip_id = 'T1'").withColumn("stop_sequence", F.col("stop_sequence").cast("int"))):
        lines = [r.line.split(",") for r in gtfs_text.numbered_lines(frame, "stop_times").orderBy("line_no").collect()]
        assert lines[0] == ["trip_id", "stop_id", "stop_sequence"]
        assert [(a, b) for a, _, b in lines[1:]] == expected[-len(lines) + 1 :]


def test_imports_append_to_tables_without_a_key_and_a_replay_changes_nothing(spark, scratch):
    root = f"{scratch}/store"
    first, second = {**MINIMAL, "feed_info.txt": INFO + "P,https://p.example,pt\n"}, {**MINIMAL, "feed_info.txt": INFO + "Q,https://q.example,pt\nQ,https://q.example,pt\n"}
    st = _import(spark, f"{scratch}/a", root, {"A": first, "B": first})
    _import(spark, f"{scratch}/b", root, {"A": second})
    rows = lambda: sorted((r.feed_id, r.row_order, r.feed_publisher_name) for r in st.read("feed_info").collect())
    want = [("A", 1, "P"), ("A", 2, "Q"), ("A", 3, "Q"), ("B", 1, "P")]
    assert rows() == want
    files = {p: t for p, t in _files(root).items() if "feed_info" in p}
    for again, folder in ((first, "c"), (second, "d")):
        _import(spark, f"{scratch}/{folder}", root, {"A": again})
        assert rows() == want
    assert {p: t for p, t in _files(root).items() if "feed_info" in p} == files
    # the same row in another archive is another row
    other = {**first, "stops.txt": MINIMAL["stops.txt"] + "S9,Nine,41,-8\n"}
    _import(spark, f"{scratch}/e", root, {"A": other})
    assert rows() == [*want[:3], ("A", 4, "P"), want[3]]
    _import(spark, f"{scratch}/f", root, {"A": first}, "replace")
    assert rows() == [("A", 1, "P"), ("B", 1, "P")]


def test_counts_come_from_file_footers(spark, scratch, capfd):
    st = _import(spark, f"{scratch}/a", f"{scratch}/store", {"A": MINIMAL, "B": {**MINIMAL, "stops.txt": MINIMAL["stops.txt"] + "S9,Nine,41,-8\n"}})
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_rows(st.counts()) == as_rows(store.table_counts(st.tables()))
    side = spark.newSession()
    side.conf.set("spark.sql.sources.useV1SourceList", "")
    side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    st._footer_counts(side, "stops").explain("formatted")
    plan = capfd.readouterr().out
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [feed_id, batch]" in plan
    assert store.GtfsStore(spark, f"{scratch}/none").counts().count() == 0
