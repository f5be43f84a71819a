"""The ordered scan over ranges against Spark's own windows, and the operators built on it."""

from __future__ import annotations

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from railyard.operators import mapping, ordered, service, validate


def _same(spark, df, part, order, ranges):
    w = Window.partitionBy(*part).orderBy(*order)
    want = df.select("*", F.lag("v").over(w).alias("before"), F.first("v").over(w).alias("head"), F.row_number().over(w).cast("long").alias("k"))
    got = ordered.range_scan(df, part, order, lag={"before": "v"}, first={"head": "v"}, index="k", num_ranges=ranges)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_range_scan_matches_windows(spark):
    rng = random.Random(3)
    rows = [(f, rng.choice([None, "", "T1", "T2", f"t{rng.randrange(40)}"]), i, rng.choice([None, rng.randrange(9)])) for f in ("A", "B") for i in range(700)]
    df = spark.createDataFrame(rows, "feed_id string, trip_id string, n long, v long")
    for ranges in (1, 3, 50):
        _same(spark, df, ["feed_id", "trip_id"], ["n"], ranges)
    _same(spark, df.where("false"), ["feed_id", "trip_id"], ["n"], 4)


def test_one_group_runs_in_many_tasks(spark):
    """All rows under one blank trip id: the state is carried over every range."""
    df = spark.range(0, 40_000, 1, 6).select(F.lit("A").alias("feed_id"), F.lit("").alias("trip_id"), F.col("id").alias("row_num"),
                                            F.when(F.col("id") % 1000 == 999, F.col("id") - 5).otherwise(F.col("id")).cast("string").alias("stop_sequence"))
    scanned = ordered.range_scan(df, ["feed_id", "trip_id"], ["row_num"], lag={"p": "row_num"}, index="k", num_ranges=16)
    assert scanned.where("k <> row_num + 1 or (row_num > 0 and p <> row_num - 1)").count() == 0
    assert scanned.where("p is null").count() == 1
    sizes = [r["count"] for r in scanned.groupBy(F.floor(F.col("k") / 2500)).count().collect()]
    assert len(sizes) >= 16
    issues = validate.stop_sequence_order(df)[0]
    assert issues.count() == 40


def test_stop_times_of_one_long_line(spark):
    n = 3000
    ops = spark.range(n).select(F.lit("A").alias("feed_id"), F.lit("L1").alias("line_id"), F.lit(0).alias("direction_id"), F.concat(F.lit("S"), "id").alias("stop_id"),
                                (F.col("id") + 1).alias("stop_sequence"), F.when(F.col("id") == 0, F.lit("06:30:00")).alias("service_start_time"),
                                F.when(F.col("id") == 0, F.lit("30")).alias("average_dwell_time"), F.col("id").alias("row_num"))
    trips = spark.createDataFrame([("A", "L1", 0, "T")], "feed_id string, route_id string, direction_id int, trip_id string")
    out = {r.stop_sequence: r for r in mapping.map_stop_times(ops, trips, ["row_num"]).collect()}
    assert len(out) == n and out[1].arrival_time == "06:30:00"
    dwell = int(out[1].departure_time[-2:]) + 60 * int(out[1].departure_time[3:5]) - 1800
    secs = lambda t: sum(int(x) * f for x, f in zip(t.split(":"), (3600, 60, 1)))
    assert all(secs(out[k].arrival_time) == 6.5 * 3600 + (k - 1) * (dwell + 120) for k in (2, 100, n))


def test_distance_from_stop_to_stop_where_shape_distance_is_absent(spark):
    stops = spark.createDataFrame([("A", "S1", "41.0", "-8.0"), ("A", "S2", "41.0", "-8.5"), ("A", "S3", "41.5", "-8.5"), ("A", "X", "999", "0"), ("A", "N", None, None)],
                                  "feed_id string, stop_id string, stop_lat string, stop_lon string")
    calls = [("T1", ["S1", "X", "S2", "N", "S3"], None), ("T2", ["S1", "S2"], 7.5), ("T3", ["S1", "X"], None)]
    st = spark.createDataFrame([("A", t, s, 10 - k if t == "T9" else k, 100 * k, d) for t, ss, d in calls for k, s in enumerate(ss)],
                               "feed_id string, trip_id string, stop_id string, stop_sequence int, arrival_secs int, shape_dist_traveled double")

    def km(a, b):
        (p, q), (r, s) = [tuple(map(math.radians, x)) for x in (a, b)]
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2))

    want = km((41, -8), (41, -8.5)) + km((41, -8.5), (41.5, -8.5))
    got = {r.trip_id: r.path_km for r in service.path_lengths(st, stops).collect()}
    assert abs(got["T1"] - want) < 1e-9 and got["T3"] is None
    active = spark.createDataFrame([("A", "W", "2024-01-01")], "feed_id string, service_id string, date string")
    trips = spark.createDataFrame([("A", f"T{k}", f"R{k}", "W", 0) for k in (1, 2, 3)], "feed_id string, trip_id string, route_id string, service_id string, direction_id int")
    dist = lambda *more: {r.route_id: r.service_distance for r in service.route_stats(active, trips, st, *more).collect()}
    assert dist(stops) == {"R1": round(want, 6), "R2": 7.5, "R3": None}
    assert dist() == {"R1": None, "R2": 7.5, "R3": None}


def test_small_groups_need_no_ranges(spark, monkeypatch):
    """Groups that fit a task go through a window, larger ones through the ranges; the rows are the same either way."""
    df = spark.range(400).select(F.lit("A").alias("feed_id"), F.when(F.col("id") < 300, "hot").when(F.col("id") % 2 == 0, (F.col("id") % 7).cast("string")).alias("trip_id"),
                                 F.col("id").alias("n"), (F.col("id") % 5).alias("v"))
    part, want = ["feed_id", "trip_id"], None
    for most, split in ((1000, (400, 0)), (200, (100, 300)), (0, (0, 400))):
        small, large = ordered.by_group_size(df, part, most)
        assert (small.count() if small else 0, large.count() if large else 0) == split
        monkeypatch.setattr(ordered, "by_group_size", lambda *_, s=small, b=large: (s, b))
        got = sorted(map(str, ordered.range_scan(df, part, ["n"], {"before": "v"}, {"head": "v"}, "k").collect()))
        monkeypatch.undo()
        want = want or got
        assert got == want
    plan = ordered.lag_over(df, part, ["n"], "v", "before")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "BroadcastHashJoin" not in plan


def test_duplicates_of_small_and_large_keys(spark):
    df = spark.range(60).select(F.when(F.col("id") < 40, 1).when(F.col("id") < 55, F.col("id") % 7).alias("k"), F.col("id").alias("n"))
    found = [sorted(map(str, ordered.duplicates_after_first(df, ["k"], ["n"], "first", most).collect())) for most in (1000, 10, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 55 - 7
    plan = ordered.duplicates_after_first(df, ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_numbers_are_not_gathered_by_feed(spark):
    """Ordinals, and those that go on from a feed's last number, shuffle the rows by range only."""
    df = spark.range(0, 900, 1, 4).select(F.when(F.col("id") % 3 == 0, "B").otherwise("A").alias("feed_id"), F.col("id").alias("n"))
    after = spark.createDataFrame([("A", 1000)], "feed_id string, top long")
    for start, extra in ((None, 0), (after, 1000)):
        out = ordered.dense_ordinal(df, ["feed_id"], ["n"], "k", num_ranges=5, after=start)
        got = {f: sorted((r.n, r.k) for r in out.where(F.col("feed_id") == f).collect()) for f in ("A", "B")}
        assert [k for _, k in got["A"]] == list(range(1 + extra, 601 + extra)) and [k for _, k in got["B"]] == list(range(1, 301))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan.split("Initial Plan")[-1].split("BroadcastExchange")[0]
