"""Outlines as rows of sides: containment, coverage, overlap areas and visible vertices against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.operators import grid as gd
from concourse.operators import slabs as sl
from concourse.operators import spatial as sp

RING = "ring array<struct<x:double,y:double>>"


def star(cx, cy, points, rng, low=4.0, high=9.0):
    """A simple ring around a centre, concave nearly everywhere."""
    out = []
    for i in range(points):
        r = rng.uniform(low, high)
        out.append((cx + r * math.cos(2 * math.pi * i / points), cy + r * math.sin(2 * math.pi * i / points)))
    return out


def holds(ring, x, y, slack=1e-9):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        t = 0.0 if (ax, ay) == (bx, by) else max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        if math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= slack:
            return True
        odd ^= (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay)
    return odd


def polygons(spark, rings, key="area_id"):
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring in rings]
    return sp.ring_box(spark.createDataFrame(rows, f"{key} long, {RING}").repartition(3))


def test_points_in_outlines_of_many_sides(spark):
    rng = random.Random(5)
    rings = {i: star(rng.uniform(0, 30), rng.uniform(0, 30), n, rng) for i, n in enumerate([3, 5, 40, 400, 1500])}
    rings[9] = [(0, 0), (10, 0), (10, 10), (0, 10)]
    spots = [(i, rng.uniform(-5, 40), rng.uniform(-5, 40)) for i in range(400)] + [(1000, 10.0, 5.0), (1001, 0.0, 0.0), (1002, 10.0, 10.0), (1003, 10.1, 5.0)]
    spots += [(2000, float("nan"), 1.0), (2001, float("inf"), 1.0), (2002, None, 1.0), (2003, 1e300, 1e300)]
    outlines = polygons(spark, [*rings.items(), (20, [(0, 0), (1, 1)]), (21, [(0, 0), (float("inf"), 1), (1, 5)]), (22, [(0, 0), (float("nan"), 1), (1, 5)])])
    points = spark.createDataFrame(spots, "point_id long, x double, y double").repartition(4)
    got = {(r["point_id"], r["area_id"]) for r in sp.points_in_polygons(points, outlines, ["area_id"]).collect()}
    real = [s for s in spots if s[0] < 2000]
    assert got == {(p, k) for p, x, y in real for k, ring in rings.items() if holds(ring, x, y)} and len(got) > 150


def test_slabs_are_linear_in_the_sides(spark):
    rng = random.Random(1)
    ring = star(0, 0, 20_000, rng, 50.0, 50.5)
    comb = [(i / 100, (i % 2) * 100.0) for i in range(4001)] + [(40.0, -1.0), (0.0, -1.0)]  # every side as tall as the outline
    outlines = sl.framed(polygons(spark, [(1, ring), (2, comb)]), ["area_id"])
    rows = sl.side_slabs(outlines, ["area_id"], 1e-8)
    assert rows.count() <= 3 * (len(ring) + len(comb))
    fullest = rows.filter("area_id = 1").groupBy("_level", "_slab").count().agg({"count": "max"}).first()[0]
    assert fullest < 2000


def test_union_coverage_and_interiors(spark):
    rng = random.Random(8)
    rings = [(i, star(rng.uniform(0, 25), rng.uniform(0, 25), rng.randint(3, 12), rng)) for i in range(25)]
    rings += [(100, [(40, 0), (50, 0), (50, 10), (40, 10)]), (101, [(50, 0), (60, 0), (60, 10), (50, 10)]), (102, [(60.001, 0), (70, 0), (70, 10), (60.001, 10)])]
    segments = [(i, *[rng.uniform(0, 25) for _ in range(4)]) for i in range(200)]
    segments += [(300, 41.0, 5.0, 59.0, 5.0), (301, 41.0, 5.0, 65.0, 5.0), (302, 40.0, 0.0, 60.0, 0.0), (303, 50.0, 2.0, 50.0, 8.0), (304, 45.0, 5.0, 45.0, 5.0), (305, 80.0, 5.0, 80.0, 5.0), (306, 40.0, 10.0, 50.0, 0.0)]
    s = spark.createDataFrame(segments, "seg long, ax double, ay double, bx double, by_ double").repartition(4)
    out = {r["seg"] for r in sp.uncovered_by_union(s, polygons(spark, rings), "seg", ["area_id"]).collect()}
    for k, ax, ay, bx, by in segments:
        if k < 300:
            free = [i for i in range(2001) if not any(holds(ring, ax + (bx - ax) * i / 2000, ay + (by - ay) * i / 2000) for _, ring in rings)]
            assert (k in out) == bool(free) or (k in out and math.hypot(bx - ax, by - ay) > 0), k  # a gap finer than the samples
    assert {k for k in out if k >= 300} == {301, 305}
    lengths = {(r["seg"], r["area_id"]): r["inside"] for r in sp.interior_overlap(s, polygons(spark, rings), "seg", "area_id", 0.2).collect()}
    for k, ax, ay, bx, by in segments[:60]:
        for p, ring in rings[:25]:
            share = sum(holds(ring, ax + (bx - ax) * (i + 0.5) / 4000, ay + (by - ay) * (i + 0.5) / 4000) for i in range(4000)) / 4000
            assert lengths.get((k, p), 0.0) == pytest.approx(share * math.hypot(bx - ax, by - ay), abs=0.25)


def test_overlap_areas_of_concave_rings(spark):
    ell = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    square = [(1, 1), (5, 1), (5, 5), (1, 5)]
    rings = [(1, ell), (2, square), (3, ell[::-1]), (4, [(4, 0), (8, 0), (8, 4), (4, 4)]), (5, [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]), (6, [(90, 90), (91, 90), (90, 91)])]
    got = {(r["left_id"], r["right_id"]): r["area"] for r in sp.overlap_pairs(polygons(spark, rings), "area_id", 1e-6).collect()}
    want = {(1, 2): 5.0, (1, 3): 12.0, (2, 3): 5.0, (1, 5): 1.0, (3, 5): 1.0, (2, 5): 0.25, (2, 4): 3.0}
    assert got == pytest.approx(want)
    rng = random.Random(3)
    stars = [(i, star(rng.uniform(0, 12), rng.uniform(0, 12), rng.randint(3, 9), rng)) for i in range(8)]
    got = {(r["left_id"], r["right_id"]): r["area"] for r in sp.overlap_pairs(polygons(spark, stars), "area_id", 0.5).collect()}
    step = 0.1
    seen: dict = {}
    for i in range(-100, 250):
        for j in range(-100, 250):
            x, y = (i + 0.5) * step, (j + 0.5) * step
            inside = [k for k, ring in stars if abs(x - ring[0][0]) < 25 and holds(ring, x, y)]
            for n, a in enumerate(inside):
                for z in inside[n + 1 :]:
                    seen[a, z] = seen.get((a, z), 0) + step * step
    assert {k for k, v in seen.items() if v > 1} <= set(got)
    assert all(abs(v - seen.get(k, 0)) < 0.05 * v + 0.4 for k, v in got.items())


def test_snap_sees_past_no_wall(spark):
    # A wall between the point and its nearest vertex; the next one is in sight.
    room = [(0, 0), (10, 0), (10, 10), (0, 10)]
    wall = [(2.4, 0.5), (2.6, 0.5), (2.6, 9.5), (2.4, 9.5)]
    domains = polygons(spark, [(1, room), (1, wall), (2, room)], "domain_id")
    points = spark.createDataFrame([(1, 1, 2.7, 5.2), (2, 2, 2.3, 5.2), (3, 1, 2.3, 5.2), (4, 1, 2.5, 5.0), (5, 1, 50.0, 5.0), (6, 3, 5.0, 5.0)], "point_id long, domain_id long, x double, y double")
    cells = spark.createDataFrame([(2, 5), (3, 5), (3, 6), (1, 5), (4, 9)], "ix long, iy long")
    seen = {r["point_id"]: (r["ix"], r["iy"]) for r in sp.snap_to_grid(points, cells, 1.0, domains=domains).collect()}
    assert seen == {1: (3, 5), 2: (2, 5), 3: (2, 5)}
    hidden = spark.createDataFrame([(2, 5), (1, 5)], "ix long, iy long")
    seen = {r["point_id"]: (r["ix"], r["iy"]) for r in sp.snap_to_grid(points, hidden, 1.0, domains=domains).collect()}
    assert seen == {2: (2, 5), 3: (2, 5)}  # point 1 is nearer to (2, 5), but behind the wall


def test_endpoints_fall_back_and_report_the_missing(spark):
    room = [(0, 0), (60, 0), (60, 60), (0, 60)]
    doors = [
        (1, 1, 20.0, 20.0, 24.0, 20.0, None, None),  # both sides inside
        (2, 1, 0.0, 10.0, 0.0, 14.0, None, None),  # in the outer wall: one side inside
        (3, 1, None, None, None, None, 31.0, 32.0),  # no segment: its point
        (4, 1, None, None, None, None, None, None),  # nothing to go by
        (5, 1, 200.0, 0.0, 204.0, 0.0, 30.0, 30.0),  # far outside; a door with a segment has no fallback
    ]
    d = spark.createDataFrame(doors, "door_id long, domain_id long, ax double, ay double, bx double, by_ double, fx double, fy double")
    cells = [(i, j, float(i + j) if (i, j) != (10, 10) else None) for i in range(1, 20) for j in range(1, 20)]
    v = spark.createDataFrame(cells, "ix long, iy long, path_distance double")
    got = {r["door_id"]: r for r in gd.choose_endpoints(d, polygons(spark, [(1, room)], "domain_id"), v, 3.0).collect()}
    assert {k: r["found"] for k, r in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert (got[1]["door_distance"], got[1]["y"]) == (2.0, 18.0) and got[2]["x"] == 2.0
    assert (got[3]["door_distance"], got[3]["x"], got[3]["y"]) == (0.0, 31.0, 32.0)
    assert got[4]["x"] is None and got[5]["ix"] is None


def test_cells_meet_the_few_sides_of_their_domain_at_once(spark, monkeypatch):
    monkeypatch.setattr(gd, "nearest_sides", lambda *_: pytest.fail("a reach was grown for a domain of four sides"))
    ring = [(0.0, 0.0), (300.0, 0.0), (300.0, 300.0), (0.0, 300.0)]
    points = [{"x": x, "y": y} for x, y in ring]
    rows = [(1, points, 0.0, 0.0, 300.0, 300.0)]
    schema = "domain_id int, ring array<struct<x:double,y:double>>, min_x double, min_y double, max_x double, max_y double"
    domains = spark.createDataFrame(rows, schema)
    cells = gd.grid_cells(domains, 3.0)
    assert cells.select(F.spark_partition_id()).distinct().count() > 1
    found = gd.clearance(cells, domains, 3.0).collect()
    assert len(found) == 99 * 99
    assert all(abs(r.clearance - min(r.x, r.y, 300 - r.x, 300 - r.y)) < 1e-9 for r in found)
