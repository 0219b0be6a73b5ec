"""Outlines of many sides: contacts found between rows are those found within one row."""

import math
import random

import pytest

from concourse.operators import contract

RING = "bundle_id string, ord int, ring array<struct<x:double,y:double>>"


def circle(n, radius=1.0, at=0.0, wave=0.0):
    r = lambda i: radius * (1 + wave * (i % 2))
    return [(at + r(i) * math.cos(2 * math.pi * i / n), r(i) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def faults(spark, rows):
    found = contract.ring_faults(spark.createDataFrame(rows, RING), 1e-9, 1e-12)
    return sorted((r["bundle_id"] or "", r["ord"], r["ring_fault"]) for r in found.collect())


def test_rows_agree_with_one_row(spark, monkeypatch):
    draw = random.Random(5)
    rings = []
    for k in range(40):
        n = draw.choice([5, 9, 30, 70])
        ring = circle(n, draw.choice([1e-3, 1.0, 500.0]), draw.choice([0.0, -40.0]), draw.choice([0.0, 0.3]))
        if k % 2:
            i, j = draw.sample(range(n), 2)
            ring[i], ring[j] = ring[j], ring[i]
        if k % 5 == 0:
            ring[n // 2] = ring[0]
        rings.append(("b", k, ring))
    # Equal names hold different rings, and a name may be unknown.
    rings += [("b", 0, circle(80)), (None, 1, circle(80)), ("c", 2, []), ("c", 3, [(float("nan"), 0.0)] * 90)]
    monkeypatch.setattr(contract, "SIDES_IN_ROW", 10**6)
    want = faults(spark, rings)
    monkeypatch.setattr(contract, "SIDES_IN_ROW", 3)
    assert faults(spark, rings) == want
    assert {f for _, _, f in want} >= {"self-intersection", "not finite", "too few points"}


@pytest.mark.parametrize("knot", [False, True])
def test_ring_of_many_sides(spark, knot):
    ring = circle(20000, 3.0)
    if knot:
        ring[7000], ring[7002] = ring[7002], ring[7000]
    got = faults(spark, [("b", 0, ring), ("b", 1, circle(4))])
    assert got == ([("b", 0, "self-intersection")] if knot else [])


def test_the_sides_of_a_ring_are_made_once(spark):
    bow = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 3.0))]
    found = contract.ring_faults(spark.createDataFrame([("b", 1, bow)], RING), 1e-9, 1e-12)
    assert [r["ring_fault"] for r in found.collect()] == ["self-intersection"]
    # Eighteen when each side of a ring made them all again.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("arrays_zip(") <= 12
