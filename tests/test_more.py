"""Batch routing, subset export, lineage listings, maturity, mapping report."""

from __future__ import annotations

import sys
import os as _os

sys.path.insert(0, _os.path.dirname(_os.path.abspath(__file__)))

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from railyard.operators import store
from railyard.sinks import gtfs_text
from railyard.sources import lineage, tabular


def test_batch_preview_routing_and_problems(spark, scratch):
    d = f"{scratch}/batch"
    os.makedirs(d)
    for name, text in {"stops.txt": "stop_id\nS1\nS2\n", "trips.csv": "trip_id\nT1\n", "notes.txt": "x\n1\n",
                       "Stops.csv": "stop_id\nS3\n", "mystery.txt": "a\n1\n"}.items():
        with open(f"{d}/{name}", "w") as fh:
            fh.write(text)
    pv = {r.file_name: r for r in tabular.batch_preview(spark, d, overrides={"mystery.txt": "routes"}).collect()}
    assert pv["stops.txt"].table_name == "stops" and pv["stops.txt"].data_rows == 2
    assert "duplicate target table" in pv["stops.txt"].problems and "duplicate target table" in pv["Stops.csv"].problems
    assert pv["trips.csv"].problems == []
    assert pv["notes.txt"].table_name is None and pv["notes.txt"].problems == ["unknown table"]
    assert pv["mystery.txt"].table_name == "routes"


def test_subset_export_and_empty_result(spark, scratch):
    from test_fixtures import _netex_feed

    f = _netex_feed(spark)
    out = f"{scratch}/subset"
    errors = gtfs_text.export_subset(f, out, route_ids=spark.createDataFrame([("F", "R2")], "feed_id string, route_id string"))
    assert errors.count() == 0
    trips = open(glob.glob(f"{out}/feed_id=F/table=trips/part-*.txt")[0], newline="").read()
    assert "T_NIGHT" in trips and "T1" not in trips.replace("T_NIGHT", "")
    none = gtfs_text.export_subset(f, f"{scratch}/none",
                                   route_ids=spark.createDataFrame([("F", "NOPE")], "feed_id string, route_id string"))
    assert [r.message for r in none.collect()] == ["No trips remain after restriction"]


def test_lineage_listing_latest_and_maturity(spark, scratch):
    t = dt.datetime
    runs = spark.createDataFrame([
        ("p1", "r1", t(2024, 1, 1), ["b/a.csv"], ["s/stops.parquet"], []),
        ("p1", "r2", t(2024, 2, 1), ["b/a.csv"], ["s/stops.parquet", "s/trips.parquet"], []),
        ("p2", "r3", t(2024, 1, 5), [], [], []),
    ], lineage.LINEAGE)
    lineage.write_lineage(runs, f"{scratch}/lineage")
    lin = lineage.read_lineage(spark, f"{scratch}/lineage")
    assert [r.run_id for r in lineage.list_runs(lin).where(F.col("project") == "p1").collect()] == ["r2", "r1"]
    latest = {(r.project, r.dataset): r.path for r in lineage.latest_silver(lin).collect()}
    assert latest == {("p1", "stops"): "s/stops.parquet", ("p1", "trips"): "s/trips.parquet"}
    exports = spark.createDataFrame([("p1", "e/full_1.zip", t(2024, 1, 1)), ("p1", "e/subset_2.zip", t(2024, 3, 1)),
                                     ("p1", "e/full_2.zip", t(2024, 2, 1))], "project string, path string, modified timestamp")
    assert lineage.latest_export(exports).first().path == "e/full_2.zip"
    bronze = lin.where(F.size("bronze") > 0).select("project")
    silver = lin.where(F.size("silver") > 0).select("project")
    counts = spark.createDataFrame([("p1", "stops", 3), ("p2", "stops", 0)], "feed_id string, table_name string, records long")
    mat = {r.project: r.maturity_level for r in lineage.maturity(bronze, silver, counts, exports.select("project")).collect()}
    assert mat == {"p1": 4, "p2": 0}


def test_mapping_report(spark):
    mapped = {"stops": spark.createDataFrame([("F", "S1"), ("F", "S2")], "feed_id string, stop_id string"),
              "trips": spark.createDataFrame([("F", "T1")], "feed_id string, trip_id string")}
    failed = {"stops": spark.createDataFrame([("F", "bad")], "feed_id string, stop_id string")}
    warnings = spark.createDataFrame([("F", i, f"w{i}") for i in range(30)], "feed_id string, ordinal int, message string")
    totals, first = store.mapping_report(mapped, failed, warnings)
    r = totals.first()
    assert (r.mapped, r.failed) == (3, 1) and "agency" in r.unmapped_tables and "stops" not in r.unmapped_tables
    assert first.count() == 20


def test_feature_store_gold_and_bronze_layout(spark, scratch):
    from railyard.sinks import layers

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    paths = layers.save_feature_store({"Demand Samples": df}, f"{scratch}/fs", "Base Case", "r7")
    assert paths["Demand Samples"].endswith("scenario=base_case/run_id=r7/demand_samples")
    audit = spark.read.json(f"{scratch}/fs/scenario=base_case/run_id=r7/_audit").collect()
    assert [(r.dataset, r.run_id) for r in audit] == [("Demand Samples", "r7")]
    gold = layers.save_gold(df, scratch, "P", "r1", "mode_a_samples", {"economic_context": df})
    assert spark.read.parquet(gold["mode_a_samples"]).count() == 2 and "economic_context" in gold
    src = f"{scratch}/upload.csv"
    with open(src, "w") as fh:
        fh.write("a,b\n1,2\n")
    out = layers.save_bronze(spark, src, scratch, "P", "r1")
    row = spark.read.parquet(out).first()
    assert bytes(row.content) == b"a,b\n1,2\n"
