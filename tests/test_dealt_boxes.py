"""Many boxes on both sides: every pair once, from all slices, and distances as the expression gives them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.operators.spatial import SEG, WALL, bbox_join, within_distance


def _lines(spark, n: int, name: str, cols, seed: int):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, size = rnd.randint(-60, 60), rnd.randint(-60, 60), rnd.choice([0, 1, 3, 9, 40])
        rows.append((i, x, y, x + rnd.randint(-size, size), y + rnd.randint(-size, size)))
    return spark.createDataFrame(rows, f"{name} long, " + ", ".join(f"{c} long" for c in cols))


def test_dealt_boxes_meet_once_and_in_many_tasks(spark):
    left, right = _lines(spark, 150, "a", SEG, 1).coalesce(1), _lines(spark, 170, "z", WALL, 2).coalesce(1)
    span = lambda c: [F.least(c[0], c[2]), F.least(c[1], c[3]), F.greatest(c[0], c[2]), F.greatest(c[1], c[3])]
    joined = bbox_join(left, right, span(SEG), span(WALL), 1.0, pad=2.5, dealt=True)
    assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = sorted(map(tuple, joined.select("a", "z").collect()))
    near = lambda s, w, i: min(s[i], s[i + 2]) - 2.5 <= max(w[i], w[i + 2]) and min(w[i], w[i + 2]) <= max(s[i], s[i + 2]) + 2.5
    want = sorted((a.a, z.z) for a in left.collect() for z in right.collect() if near(a[1:], z[1:], 0) and near(a[1:], z[1:], 1))
    assert got == want


def test_gaps_equal_the_expression(spark):
    left, right = _lines(spark, 60, "a", SEG, 3), _lines(spark, 60, "z", WALL, 4)
    exact = g.segment_distance(*[F.col(c).cast("double") for c in SEG + WALL])
    want = left.crossJoin(right).select("a", "z", exact.alias("gap")).filter("gap < 4")
    got = within_distance(left, right, 4.0, dealt=True).select("a", "z", "gap")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
