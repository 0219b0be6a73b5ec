"""Contacts of many segments are compared by blocks of arrays: the same pairs as by rows, each once, also in cells that several tasks share."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.operators import spatial as sp


def _lines(spark, n: int, name: str, cols, seed: int):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, size = rnd.randint(-40, 40), rnd.randint(-40, 40), rnd.choice([0, 1, 3, 9, 40, 200])
        rows.append((i, float(x), float(y), float(x + rnd.randint(-size, size)), float(y + rnd.randint(-size, size)), f"{name}{i % 7}" if i % 5 else None))
    rows += [(n, float("nan"), 0.0, 1.0, 1.0, "nan"), (n + 1, None, 0.0, 1.0, 1.0, "none")]
    return spark.createDataFrame(rows, f"{name} long, " + ", ".join(f"{c} double" for c in cols) + f", {name}_kind string")


@pytest.mark.parametrize("most", [sp.CELL_PAIRS, 50])
def test_blocks_give_the_pairs_of_rows(spark, monkeypatch, most):
    monkeypatch.setattr(sp, "CELL_PAIRS", most)
    left, right = _lines(spark, 260, "a", sp.SEG, 1), _lines(spark, 240, "z", sp.WALL, 2)
    for tol in (g.CONTRACT, g.ROUTER, g.OUTLINE):
        found = sp.segment_hits(left, right, tol, 2.0, dealt=True)
        assert found.columns == [*left.columns, *right.columns]
        want = sp.segment_hits(left, right, tol, 2.0)
        got = sorted(map(str, found.collect()))
        assert len(got) == len(set(got)) > 900
        assert got == sorted(map(str, want.select(*found.columns).collect()))


def test_only_pairs_in_contact_become_rows(spark):
    left, right = _lines(spark, 50, "a", sp.SEG, 3), _lines(spark, 50, "z", sp.WALL, 4)
    found = sp.segment_hits(left, right, base=2.0, dealt=True, keep=["a", "z"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == ["a", "z"] and "MapInArrow" in plan and "Join" not in plan
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
