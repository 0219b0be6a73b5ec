"""Snapping looks at few vertices of a point that sees its nearest one, and still finds the nearest of all that it sees."""

from __future__ import annotations

from concourse.operators import spatial as sp

ROOM = [(1, [(x, y) for x, y in ((-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0))], -50.0, -50.0, 50.0, 50.0)]
DOMAIN = "domain_id long, ring array<struct<x double, y double>>, min_x double, min_y double, max_x double, max_y double"


def _snap(spark, points, cells):
    domains = spark.createDataFrame(ROOM, DOMAIN)
    asked = spark.createDataFrame(points, "point_id long, domain_id long, x double, y double")
    found = sp.snap_to_grid(asked, spark.createDataFrame(cells, "ix long, iy long"), 1.0, domains=domains)
    return {r["point_id"]: (r["ix"], r["iy"]) for r in found.collect()}


def test_a_point_that_sees_its_nearest_vertex_tries_no_other(spark, monkeypatch):
    tried = []
    whole = sp.within_domain
    monkeypatch.setattr(sp, "within_domain", lambda segments, *rest: tried.append(segments.count()) or whole(segments, *rest))
    points = [(i, 1, i + 0.3, 2 * i + 0.6) for i in range(-9, 10)]
    got = _snap(spark, points, [(i, j) for i in range(-20, 21) for j in range(-20, 21)])
    assert got == {i: (i, 2 * i + 1) for i in range(-9, 10)}
    assert sum(tried) == len(points)


def test_a_vertex_outside_the_square_can_be_nearer_than_its_corner(spark):
    # The corner (-1, -1) of the inner square is 2.1 away, (2, 0) is 1.6; (-3, -3) is 4.9 away, (4, 0) is 3.5.
    points = [(1, 1, 0.49, 0.49)]
    assert _snap(spark, points, [(-1, -1), (2, 0)]) == {1: (2, 0)}
    assert _snap(spark, points, [(-3, -3), (4, 0)]) == {1: (4, 0)}
    assert _snap(spark, points, [(10, 10), (-11, 0)]) == {1: (10, 10)}
    assert _snap(spark, [(1, 1, 0.0, 0.0), (2, 1, 99.0, 0.0)], [(0, 0), (98, 0), (1, 1)]) == {1: (1, 1)}
