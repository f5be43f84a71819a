"""Randomised checks against small brute-force Python models."""

from __future__ import annotations

import bisect
import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from railyard.operators import features as FE
from railyard.operators import ordered, quality, service


def test_as_of_matches_searchsorted_model(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 3, 1)
    rows_w, rows_p, model = [], [], {}
    for feed in ("A", "B"):
        # observations on some days only (gaps force intervals spanning days)
        obs = sorted({base + dt.timedelta(days=rnd.choice([1, 2, 5, 6, 9]), minutes=rnd.randrange(1440))
                      for _ in range(25)})
        for i, t in enumerate(obs):
            rows_w.append((feed, t, float(i), None if i % 7 == 0 else float(i) / 2))
        for j in range(120):
            t = base + dt.timedelta(days=rnd.randrange(-2, 13), minutes=rnd.randrange(1440))
            if j % 17 == 0 and obs:
                t = rnd.choice(obs)  # exact hits take the equal observation
            rows_p.append((feed, j, t))
            k = bisect.bisect_left(obs, t)
            k = min(k, len(obs) - 1)
            model[(feed, j)] = (float(k), None if k % 7 == 0 else float(k) / 2)
    w = spark.createDataFrame(rows_w, "feed_id string, timestamp timestamp_ntz, temperature_celsius double, "
                                      "precipitation_mm double")
    p = spark.createDataFrame(rows_p, "feed_id string, row_num int, timestamp timestamp_ntz")
    got = {(r.feed_id, r.row_num): (r.temperature_celsius, r.precipitation_mm)
           for r in FE.with_weather(p, "timestamp", w).collect()}
    assert got == model


def test_restriction_cascade_matches_model(spark):
    rnd = random.Random(11)
    stops = [(f"S{i}", (f"S{rnd.randrange(40)}" if rnd.random() < 0.3 else None)) for i in range(40)]
    routes = [(f"R{i}", f"A{i % 3}" if i % 4 else None) for i in range(8)]
    agency = [(f"A{i}",) for i in range(4)]
    trips = [(f"T{i}", f"R{rnd.randrange(8)}", f"V{rnd.randrange(3)}") for i in range(30)]
    stop_times = [(t[0], f"S{rnd.randrange(40)}", k) for t in trips for k in range(rnd.randrange(1, 5))]
    F_ = "F"
    tables = {
        "stops": spark.createDataFrame([(F_, *s) for s in stops], "feed_id string, stop_id string, parent_station string"),
        "routes": spark.createDataFrame([(F_, *r) for r in routes], "feed_id string, route_id string, agency_id string"),
        "agency": spark.createDataFrame([(F_, *a) for a in agency], "feed_id string, agency_id string"),
        "trips": spark.createDataFrame([(F_, *t) for t in trips], "feed_id string, trip_id string, route_id string, "
                                                                  "service_id string"),
        "stop_times": spark.createDataFrame([(F_, *s) for s in stop_times],
                                            "feed_id string, trip_id string, stop_id string, stop_sequence int"),
    }
    wanted = {"R1", "R4", "R6"}
    out = service.restrict_to_routes(tables, spark.createDataFrame([(F_, r) for r in wanted], "feed_id string, route_id string"))
    kt = {t[0] for t in trips if t[1] in wanted}
    used = {s[1] for s in stop_times if s[0] in kt}
    parents = {p for s, p in stops if s in used and p}
    exp_stops = {s for s, _ in stops if s in used or s in parents}
    exp_routes = {t[1] for t in trips if t[0] in kt}
    ag_ids = {a for r, a in routes if r in exp_routes}
    exp_agency = {a[0] for a in agency} if None in ag_ids else {a[0] for a in agency if a[0] in ag_ids}
    assert {r.trip_id for r in out["trips"].collect()} == kt
    assert {r.stop_id for r in out["stops"].collect()} == exp_stops
    assert {r.route_id for r in out["routes"].collect()} == exp_routes
    assert {r.agency_id for r in out["agency"].collect()} == exp_agency
    assert out["stop_times"].count() == sum(1 for s in stop_times if s[0] in kt)


def test_dense_ordinal_and_top_n(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xyz"), rnd.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    n = {(r.g, r.id): r.ord for r in ordered.dense_ordinal(df, ["g"], ["v", "id"], "ord", num_ranges=7).collect()}
    for g in "xyz":
        srt = sorted((v, i) for gg, v, i in rows if gg == g)
        assert [n[(g, i)] for _, i in srt] == list(range(1, len(srt) + 1))
    top = ordered.top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, salt=4)
    got = sorted((r.g, r.rank, r.id) for r in top.collect())
    exp = []
    for g in "xyz":
        srt = sorted(((-v, i) for gg, v, i in rows if gg == g))[:5]
        exp += [(g, k + 1, i) for k, (_, i) in enumerate(srt)]
    assert got == sorted(exp)


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    vals = {"a": [rnd.gauss(0, 10) for _ in range(301)], "b": [float(rnd.randrange(20)) for _ in range(64)]}
    rows = [(vals["a"][i] if i < 301 else None, vals["b"][i] if i < 64 else None) for i in range(301)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {(r.column_name, r.metric): r.value for r in quality.exact_quantiles(df, ["a", "b"]).collect()}
    for c in ("a", "b"):
        for name, q in quality.QUANTILES:
            assert abs(got[(c, name)] - float(np.percentile(vals[c], q * 100))) < 1e-9
