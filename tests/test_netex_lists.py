"""What NeTEx documents write and shuffle on the way, and the lists of calls that they are made from."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_fixtures import CFG, FEED, _netex_feed

from railyard.operators import netex as NX
from railyard.operators import ordered
from railyard.sinks import netex_xml


def test_documents_move_no_xml_before_the_last_stage(spark, monkeypatch):
    """Journeys and patterns are rendered after the last shuffle, and no XML is written in between."""
    kept = []
    for module in (netex_xml, NX, ordered):
        write = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, write=write: (kept.extend(df.columns), write(df))[1])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.debug.maxToStringFields": "10000", "spark.sql.maxPlanStringLength": "10000000"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        f = _netex_feed(spark)
        f["agency"] = spark.createDataFrame([(FEED, 0, "X", "X")], "feed_id string, row_num long, agency_id string, agency_name string")
        rows = netex_xml.netex_documents(f, CFG, "t")
        plan = rows._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept and not {"xml", "text"} & set(kept)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    rendered = [i for i, line in enumerate(plan) if "rowTag,ServiceJourney" in line]
    assert len(rendered) == 2  # ServiceJourney and ServiceJourneyPattern
    for i in rendered:
        level = depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < level:
                level = depth(line)
                assert "Exchange" not in line and "Join" not in line, line


def test_calls_are_dealt_once(spark):
    st = spark.range(40).select(F.lit("F").alias("feed_id"), (F.col("id") % 7).alias("trip_id"), F.col("id").alias("stop_sequence"), F.lit(1).alias("stop_id"))
    plan = NX.trip_calls(st, ["stop_sequence"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_lists_and_rows_agree_when_rows_repeat(spark):
    """A trip row that comes twice has its pattern twice: its calls count twice in both shapes."""
    trips = spark.createDataFrame([("F", "T1", "R1", 0, 1), ("F", "T1", "R1", 0, 1), ("F", "T2", "R1", None, 2), ("F", None, "R1", 0, 3)],
                                  "feed_id string, trip_id string, route_id string, direction_id int, row_num long")
    calls = [("F", "T1", 2, "B", "24:10:00", "24:11:00", 5), ("F", "T1", 1, "A", "23:50:00", None, 6), ("F", "T2", 1, "C", "", "8:05:09", 7),
             ("F", "T2", 1, "A", "08:00:00", "08:01:00", 4), ("F", None, 1, "A", "08:00:00", "08:01:00", 8)]
    st = spark.createDataFrame(calls, "feed_id string, trip_id string, stop_sequence int, stop_id string, arrival_time string, departure_time string, row_num long")
    found = []
    for rows in (st, NX.trip_calls(st, ["row_num"])):
        pats, t2p = NX.journey_patterns(trips, rows, CFG, ["row_num"], ["row_num"])
        flat = NX.passing_times(rows, t2p, CFG, ["row_num"])
        listed = NX.passing_times(rows, t2p, CFG, ["row_num"], lists=True).select("feed_id", "trip_id", F.inline("times"))
        points = NX.stop_points_in_pattern(pats, CFG)
        of_lists = NX.stop_points_in_pattern(pats, CFG, lists=True).select("feed_id", "local_id", F.inline("points"))
        assert sorted(map(tuple, points.collect())) == sorted(map(tuple, of_lists.collect()))
        found += [sorted(map(str, x.collect())) for x in (flat, listed)]
        assert {(r.local_id, *r.stops) for r in pats.collect()} == {("R1_0_1", "A", "B"), ("R1_0_2", "A", "C")}
    assert all(x == found[0] for x in found)
    times = {(r.trip_id, r.idx): r for r in flat.collect()}
    assert len(times) == 6 and [times["T1", k].arrival_time for k in range(1, 5)] == ["23:50:00"] * 2 + ["00:10:00"] * 2
    last = times["T1", 4]
    assert (last.id, last.spjp_ref) == ("PT:GUIMABUS:TimetabledPassingTime:T1_4", "PT:GUIMABUS:StopPointInJourneyPattern:R1_0_1_4")
    assert (last.arrival_day_offset, last.departure_time) == (1, "00:11:00") and times["T1", 1].departure_time is None
    assert (times["T2", 2].arrival_time, times["T2", 2].departure_time, times["T2", 2].departure_day_offset) == (None, "08:05:09", 0)


def test_equal_modes_go_by_the_whole_order(spark, monkeypatch):
    """Equal in number and in the first column of the order: the second decides; NULL comes first; a NULL stop is a stop."""
    routes = spark.createDataFrame([("F", "BUS", 3), ("F", "RAIL", 2)], "feed_id string, route_id string, route_type int")
    trips = spark.createDataFrame([("F", "B", "BUS"), ("F", "R", "RAIL")], "feed_id string, trip_id string, route_id string")
    st = [("B", "S1", 1, 2), ("R", "S1", 1, 1), ("B", "S2", 5, 1), ("R", "S2", None, 9), ("B", "S3", 1, 1), ("R", "S3", 2, 1), ("R", "S3", 3, 1),
          ("B", None, None, 3), ("R", None, None, 4), ("B", "S4", 7, 7)]
    st = spark.createDataFrame([("F", *r) for r in st], "feed_id string, trip_id string, stop_id string, day int, place int")
    want = {"S1": "rail", "S2": "rail", "S3": "rail", None: "bus", "S4": "bus"}
    for most in (ordered.SMALL_ROWS, 0):
        monkeypatch.setattr(ordered, "SMALL_ROWS", most)
        got = NX.stop_modes(routes, trips, st, ["day", "place"]).collect()
        assert len(got) == 5 and {r.stop_id: r.mode for r in got} == want
