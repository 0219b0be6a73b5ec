"""The topology report holds its negative control and a sample detour, and both tell a tree from a network."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import network as nw
from concourse.operators import relational as rl
from concourse.operators import reports as rp


def test_report_counts_what_a_tree_would_worsen_and_tells_a_detour(spark):
    # A ring of four: the tree of "a" lacks one side, so "b" and "c" reach each other through "a" only.
    rows = [("ab", "a", "b", 10), ("ac", "a", "c", 10), ("bc", "b", "c", 1), ("ad", "a", "d", 5)]
    edges = spark.createDataFrame(rows, "edge_id string, from_node string, to_node string, cost long")
    both = edges.select("edge_id", F.explode(F.array(F.struct(F.col("from_node").alias("src"), F.col("to_node").alias("dst")), F.struct(F.col("to_node").alias("src"), F.col("from_node").alias("dst")))).alias("s"), "cost")
    steps = both.select("edge_id", "s.*", "cost")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node_id string")
    matrix = nw.cost_matrix(steps, nodes)
    compared = rl.cost_vs_reference(matrix, matrix)
    detours = nw.tree_detours(steps, nodes.filter("node_id = 'a'"), nodes, full=matrix)
    trips = spark.createDataFrame([("b", "a", "c")], "start_node string, stop_node string, end_node string")
    row = rp.topology(compared, nodes, edges, detours, nw.via(matrix, trips)).collect()[0].asDict()
    assert row == {"pairs": 12, "unordered_pairs": 6, "max_ratio": 1.0, "failures": 0, "cycles": 1, "tree_worse": 2, "trip_direct": 1, "trip_via": 20}


def test_query_reports_every_step_of_the_method(spark):
    from concourse.plans import load_all

    columns = load_all()["rep_topology"].build(spark, "/root/testdata/sf0.001").columns
    assert {"tree_worse", "trip_direct", "trip_via", "unordered_pairs"} <= set(columns)
