"""Cost matrices sort no labels and equal the search for whole trees."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from concourse.operators import network as nw

def _steps(spark, seed: int):
    rnd = random.Random(seed)
    rows = [(f"e{i}", f"n{rnd.randrange(20)}", f"n{rnd.randrange(20)}", rnd.choice([0, 1, 2, 5, 30])) for i in range(70)]
    return spark.createDataFrame(rows, "edge_id string, src string, dst string, cost long")


def test_matrix_equals_the_tree_and_sorts_no_labels(spark, monkeypatch):
    plans = []
    whole = nw.cut
    monkeypatch.setattr(nw, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    steps = _steps(spark, 7)
    ends = spark.createDataFrame([(f"n{i}",) for i in (1, 4, 9, 99)], "node_id string")
    got = sorted(map(tuple, nw.cost_matrix(steps, ends).collect()))
    assert plans and not any("SortAggregate" in p for p in plans)
    tree = nw.shortest_tree(steps, ends.select(F.col("node_id").alias("source")))
    want = tree.filter(F.col("node").isin("n1", "n4", "n9", "n99") & (F.col("node") != F.col("source"))).select("source", "node", "cost")
    assert got == sorted(map(tuple, want.collect()))


def test_matrix_refuses_unusable_costs(spark):
    ends = spark.createDataFrame([("a",), ("b",)], "node_id string")
    for cost in (-1.0, None, float("nan")):
        steps = spark.createDataFrame([("e", "a", "b", cost), ("f", "a", "b", 1.0)], "edge_id string, src string, dst string, cost double")
        with pytest.raises(Exception, match="unusable cost"):
            nw.cost_matrix(steps, ends).collect()
