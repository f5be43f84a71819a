"""Polygon validity against a brute-force version in exact arithmetic."""

from __future__ import annotations

import json
import math
import random
import time
from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from railyard.sources import geojson, polygons


def square(a, b):
    return [[a, a], [b, a], [b, b], [a, b], [a, a]]


CASES = [
    ([[square(0, 4)]], True), ([[[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]]], False), ([[square(0, 4), square(1, 2)]], True),
    ([[square(0, 4), square(5, 6)]], False), ([[square(0, 4), square(3, 6)]], False), ([[square(0, 9), square(1, 8), square(2, 3)]], False),
    ([[square(0, 4), [[0, 0], [2, 1], [1, 2], [0, 0]]]], True), ([[square(0, 4), [[0, 2], [2, 1], [2, 3], [0, 2]]]], True),
    ([[square(0, 4), [[0, 2], [2, 1], [4, 2], [2, 3], [0, 2]]]], False), ([[square(0, 4), [[0, 1], [2, 1], [2, 2], [0, 2], [0, 1]]]], False),
    ([[square(0, 4)], [square(2, 6)]], False), ([[square(0, 2)], [square(2, 4)]], True), ([[square(0, 2)], [[[2, 0], [4, 0], [4, 2], [2, 2], [2, 0]]]], False),
    ([[square(0, 9)], [square(1, 2)]], False), ([[square(0, 9), square(1, 8)], [square(2, 3)]], True), ([[square(0, 2)], [square(0, 2)]], False),
    ([[[[0, 0], [4, 0], [4, 4], [4, 6], [4, 4], [0, 4], [0, 0]]]], False), ([[[[0, 0], [4, 0], [4, 4], [2, 0], [0, 4], [0, 0]]]], False),
    ([[[[0, 0], [4, 0], [4, 0], [4, 4], [0, 0]]]], True), ([[square(0, 4), [[2, 2], [4, 4], [6, 3], [2, 2]]]], False),
    # three holes that touch in a circle cut the interior apart
    ([[square(0, 9), [[2, 2], [4, 2], [3, 4], [2, 2]], [[4, 2], [6, 2], [5, 4], [4, 2]], [[3, 4], [5, 4], [4, 6], [3, 4]]]], False),
]


@pytest.mark.parametrize("rings, want", CASES)
def test_validity_of_rings_together(rings, want):
    assert polygons.valid(rings) is want
    turned = [[[[y, -x] for x, y in reversed(r)] for r in p] for p in rings]
    assert polygons.valid(turned) is want


def _cut(sides, others):
    """Midpoints of the pieces into which the other sides cut these; None where two run along each other."""
    out = []
    for a, b in sides:
        at = {Q(0), Q(1)}
        for c, d in others:
            ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
            cross, wx, wy = ux * vy - uy * vx, c[0] - a[0], c[1] - a[1]
            if cross:
                t, s = Q(wx * vy - wy * vx) / cross, Q(wx * uy - wy * ux) / cross
                if 0 <= t <= 1 and 0 <= s <= 1:
                    at.add(t)
            elif wx * uy == wy * ux:
                n = Q(ux * ux + uy * uy)
                ends = sorted(((wx * ux + wy * uy) / n, ((d[0] - a[0]) * ux + (d[1] - a[1]) * uy) / n))
                lo, hi = max(Q(0), ends[0]), min(Q(1), ends[1])
                if lo < hi:
                    return None
                if lo == hi:
                    at.add(lo)
        cuts = sorted(at)
        out += [(a[0] + (x + y) / 2 * ux_, a[1] + (x + y) / 2 * uy_) for x, y in zip(cuts, cuts[1:]) for ux_, uy_ in [(b[0] - a[0], b[1] - a[1])]]
    return out


def _in(ring, p):
    n = 0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if (y0 > p[1]) != (y1 > p[1]):
            n += x0 + Q(p[1] - y0) * (x1 - x0) / (y1 - y0) > p[0]
    return n % 2 == 1


def _meeting(a, b):
    """Points that two rings have in common; None if they run along each other."""
    found = set()
    for s in zip(a, a[1:]):
        for t in zip(b, b[1:]):
            ux, uy, vx, vy = s[1][0] - s[0][0], s[1][1] - s[0][1], t[1][0] - t[0][0], t[1][1] - t[0][1]
            cross, wx, wy = ux * vy - uy * vx, t[0][0] - s[0][0], t[0][1] - s[0][1]
            if cross:
                k, m = Q(wx * vy - wy * vx) / cross, Q(wx * uy - wy * ux) / cross
                if 0 <= k <= 1 and 0 <= m <= 1:
                    found.add((s[0][0] + k * ux, s[0][1] + k * uy))
            else:
                found |= {tuple(map(Q, p)) for p in set(s) & set(t)}
    return found


def brute(rings_of):
    rings, owner, shell = [], [], []
    for k, p in enumerate(rings_of):
        for j, r in enumerate(p):
            c = [tuple(r[0])] + [tuple(y) for x, y in zip(r, r[1:]) if x != y]
            if len(c) < 4 or len(set(c[:-1])) < len(c) - 1:
                return False
            rings.append(c), owner.append(k), shell.append(j == 0)
    for r in rings:
        s = list(zip(r, r[1:]))
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                near = j == i + 1 or (i == 0 and j == len(s) - 1)
                pieces = _cut([s[i]], [s[j]])
                if pieces is None or not near and (len(pieces) > 1 or {*s[i]} & {*s[j]} or _meeting(list(s[i]), list(s[j]))):
                    return False
    root = list(range(len(rings)))

    def find(i):
        return i if root[i] == i else find(root[i])

    place = {}
    for i, a in enumerate(rings):
        for j, b in enumerate(rings):
            if i != j:
                middles = _cut(list(zip(b, b[1:])), list(zip(a, a[1:])))
                if middles is None or len({_in(a, m) for m in middles}) > 1:
                    return False
                place[j, i] = _in(a, middles[0])  # is ring j inside ring i?
                if i < j and owner[i] == owner[j]:
                    common = _meeting(a, b)
                    if len(common) > 1 or common and find(i) == find(j):
                        return False
                    if common:
                        root[find(i)] = find(j)
    for i in range(len(rings)):
        mine = [j for j in range(len(rings)) if j != i and owner[j] == owner[i]]
        if not shell[i] and (not place[i, next(j for j in mine if shell[j])] or any(place[i, j] for j in mine if not shell[j])):
            return False
        for j in range(len(rings)):
            if shell[i] and shell[j] and i != j and place[i, j] and not any(place[i, k] for k in range(len(rings)) if owner[k] == owner[j] and not shell[k]):
                return False
    return True


def test_random_rings_match_brute_force():
    rng = random.Random(8)
    seen = {True: 0, False: 0}
    for _ in range(4000):
        def ring(size, lo, hi):
            """Corners round a middle, so that many rings are simple."""
            pts = [(rng.randint(lo, hi), rng.randint(lo, hi)) for _ in range(size)]
            mx, my = (lo + hi) / 2 + 0.1, (lo + hi) / 2 + 0.07
            pts.sort(key=lambda p: math.atan2(p[1] - my, p[0] - mx))
            return [list(p) for p in [*pts, pts[0]]]

        def polygon():
            a, b = sorted(rng.sample(range(0, 14), 2))
            return [square(0, 13) if rng.random() < 0.4 else ring(rng.randint(3, 7), a, b + 2)] + [ring(rng.randint(3, 5), c, c + rng.randint(2, 5)) for c in rng.sample(range(0, 11), rng.randint(0, 3))]

        shapes = [polygon() for _ in range(rng.choice([1, 1, 1, 2, 2, 3]))]
        want = brute(shapes)
        seen[want] += 1
        assert polygons.valid(shapes) == want, shapes
    assert min(seen.values()) > 150


def test_a_ring_of_100_000_corners_is_one_row(spark):
    n = 100_000
    wave = lambda i: 1 + 0.3 * math.sin(80 * math.pi * i / n)
    ring = [[wave(i) * math.cos(2 * math.pi * i / n), wave(i) * math.sin(2 * math.pi * i / n)] for i in range(n)]
    crossed = [*ring[:500], ring[70_000], *ring[501:]]
    comb = [p for i in range(25_000) for p in ([0, 2 * i], [1000, 2 * i + 0.5], [1000, 2 * i + 1], [0, 2 * i + 1.5])] + [[-1, 50_000], [-1, 0]]
    rows = [(k, "Polygon", json.dumps([[*r, r[0]]])) for k, r in (("wave", ring), ("crossed", crossed), ("comb", comb))]
    df = spark.createDataFrame(rows, "k string, type string, coordinates string").select("k", F.struct("type", "coordinates").alias("g"))
    start = time.time()
    assert {r.k: r.v for r in df.select("k", geojson.geometry_valid(F.col("g")).alias("v")).collect()} == {"wave": True, "crossed": False, "comb": True}
    assert time.time() - start < 120
