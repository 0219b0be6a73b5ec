"""Segments that lie in cells inside rectangles are settled without meeting the rectangles, and no others are."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import spatial as sp
from concourse.operators.slabs import framed


def _tables(spark):
    x, y = F.col("id") * 37 % 211, F.col("id") * 53 % 173
    boxes = spark.range(60).select("id", x.alias("x"), y.alias("y"))
    limits = [F.col(c).cast("double") for c in ("x", "y")] + [(F.col("x") + 40).cast("double"), (F.col("y") + 30).cast("double")]
    areas = boxes.select(F.col("id").alias("area_id"), *[v.alias(c) for c, v in zip(sp.BOX, limits)])
    low_x, low_y, high_x, high_y = sp.BOX
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    corners = [point(low_x, low_y), point(high_x, low_y), point(high_x, high_y), point(low_x, high_y)]
    middle = F.struct(F.col(low_x).alias("x"), ((F.col(low_y) + F.col(high_y)) / 2).alias("y"))
    i = F.col("id")
    ends = [i * 29 % 251, i * 31 % 203, i * 29 % 251 + i % 23 - 11, i * 31 % 203 + i % 17 - 8]
    segments = spark.range(400).select(i.alias("k"), *[v.cast("double").alias(c) for c, v in zip(sp.SEG, ends)])
    return segments, areas.withColumn("ring", F.array(*corners)), areas.withColumn("ring", F.array(*corners, middle))


def test_cells_settle_the_same_segments(spark):
    segments, plain, split = _tables(spark)
    # A fifth point makes the ring no rectangle of four points, so nothing is settled by cells.
    assert sp._held_by_cells(segments, framed(split, ["area_id"]), "k", 2.0).isEmpty()
    held = {r.k for r in sp._held_by_cells(segments, framed(plain, ["area_id"]), "k", 2.0).collect()}
    out = [{r.k for r in sp.uncovered_by_union(segments, areas, "k", ["area_id"], base=2.0).collect()} for areas in (plain, split)]
    assert out[0] == out[1]
    assert len(held) > 40 and not held & out[1] and len(out[1]) > 40
