"""Boxes that meet in groups: few boxes of a group are met as a group, many by cells, and no pair is lost or doubled."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators.spatial import FEW_BOXES, bbox_join


def _boxes(spark, groups: dict[str, int], name: str):
    rows = [(g, f"{g}{i}", float(7 * i % 90), float(11 * i % 70), float(7 * i % 90 + 5 + i % 40), float(11 * i % 70 + 3)) for g, n in groups.items() for i in range(n)]
    return spark.createDataFrame(rows, f"g string, {name} string, {name}x0 double, {name}y0 double, {name}x1 double, {name}y1 double")


def _sides(a, z):
    return [F.col(f"{n}{c}") for n in a for c in ("x0", "y0", "x1", "y1")], [F.col(f"{n}{c}") for n in z for c in ("x0", "y0", "x1", "y1")]


def test_few_and_many_boxes_give_the_same_pairs(spark):
    left = _boxes(spark, {"few": 40, "many": 60, "alone": 3}, "a")
    right = _boxes(spark, {"few": FEW_BOXES, "many": 3 * FEW_BOXES, "other": 2}, "z")
    lbox, rbox = _sides("a", "z")
    got = sorted(map(tuple, bbox_join(left, right, lbox, rbox, 1.0, ["g"], pad=2.0).select("a", "z").collect()))
    want = sorted(
        (a.a, z.z)
        for a in left.collect()
        for z in right.collect()
        if a.g == z.g and a.ax0 - 2 <= z.zx1 and z.zx0 <= a.ax1 + 2 and a.ay0 - 2 <= z.zy1 and z.zy0 <= a.ay1 + 2
    )
    assert got == want
    assert {a[:3] for a, _ in got} == {"few", "man"}


def test_few_boxes_take_no_cells(spark):
    lbox, rbox = _sides("a", "z")
    joined = bbox_join(_boxes(spark, {"g": 50}, "a"), _boxes(spark, {"g": FEW_BOXES}, "z"), lbox, rbox, 1.0, ["g"])
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
