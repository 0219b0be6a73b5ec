"""Endpoints try the least door distance first, and few domains meet their points without dealing them by domain."""

from __future__ import annotations

import pytest

from concourse.functions import geometry as g
from concourse.operators import grid as gd
from concourse.operators import spatial as sp

DOMAIN = "domain_id long, ring array<struct<x double, y double>>, min_x double, min_y double, max_x double, max_y double"
DOOR = "door_id long, domain_id long, ax double, ay double, bx double, by_ double, fx double, fy double"


def _box(domain, x0, y0, x1, y1):
    return (domain, [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))], float(x0), float(y0), float(x1), float(y1))


def _choose(spark, doors, boxes, vertices):
    domains, v = spark.createDataFrame(boxes, DOMAIN), spark.createDataFrame(vertices, "ix long, iy long, path_distance long")
    return {r["door_id"]: r for r in gd.choose_endpoints(spark.createDataFrame(doors, DOOR), domains, v, 3.0).collect()}


def _door(key, x, y):
    return (key, 1, x - 1.0, y, x + 1.0, y, None, None)


def test_doors_with_an_option_at_the_least_distance_try_no_other(spark, monkeypatch):
    tried = []
    whole = gd.snap_to_grid
    monkeypatch.setattr(gd, "snap_to_grid", lambda points, *rest, **more: tried.append(points.count()) or whole(points, *rest, **more))
    doors = [_door(i, 40.0 + i, 60.0 + i) for i in range(9)]
    got = _choose(spark, doors, [_box(1, 0, 0, 120, 120)], [(i, j, i + j) for i in range(1, 40) for j in range(1, 40)])
    assert {k: (r["found"], r["door_distance"]) for k, r in got.items()} == {i: (True, 2.0) for i in range(9)}
    assert sum(tried) == 2 * len(doors)


def test_doors_without_one_go_on_to_the_others(spark):
    # A hole of 10 by 10 around door 1; door 2 stands free, but no path leads to the vertices near its first points.
    vertices = [(i, j, None if 30 <= i and j in (19, 20, 21) else i + j) for i in range(1, 40) for j in range(1, 40)]
    doors = [_door(1, 31.0, 31.0), _door(2, 100.0, 60.0), (3, 1, None, None, None, None, 20.0, 70.0), (4, 1, 31.0, 31.0, 31.0, 31.0, 31.0, 31.0)]
    got = _choose(spark, doors, [_box(1, 0, 0, 120, 120), _box(1, 26, 26, 36, 36)], vertices)
    assert {k: (r["found"], r["door_distance"]) for k, r in got.items()} == {1: (True, 6.0), 2: (True, 6.0), 3: (True, 0.0), 4: (False, None)}
    assert (got[1]["x"], got[1]["y"]) == (31.0, 25.0) and (got[2]["x"], got[2]["y"]) == (100.0, 54.0)


@pytest.mark.parametrize("few", [True, False])
def test_few_domains_go_to_the_points(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(sp, "FEW_ROWS", 7)
    domains = spark.createDataFrame([_box(1, 0, 0, 90, 90), _box(1, 30, 30, 60, 60), _box(2, 0, 0, 9, 9)], DOMAIN)
    index = sp.indexed(domains, sp.NEAR_DOMAIN.eps)
    asked = [(1, 1, 1.0, 1.0, 80.0, 1.0), (2, 1, 1.0, 1.0, 80.0, 80.0), (3, 1, 1.0, 30.0, 80.0, 30.0), (4, 2, 1.0, 1.0, 9.0, 9.0), (5, 2, 1.0, 1.0, 10.0, 9.0)]
    segments = spark.createDataFrame(asked, "k long, domain_id long, ax double, ay double, bx double, by_ double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = sp.within_domain(segments, index, "k", g.ROUTER)
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["k"] for r in held.collect()) == [1, 3, 4]
        assert sorted(r["k"] for r in sp.within_domain(segments, domains, "k", g.ROUTER).collect()) == [1, 3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert index.whole is few and ("hashpartitioning(domain_id" in plan) is not few
