"""Groups that lie whole in a slice: scans give the same rows, and floors are joined, judged and searched without a shuffle."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from concourse.operators import network as nw
from concourse.operators import ordered as od
from concourse.operators import routing as rt
from concourse.plans import walks
from concourse.plans.registry import Tables, load_all
from concourse.session import cut, grouped, whole_groups

FOLDER = "/root/testdata/sf0.001"


def _dealt(spark, rows, schema):
    own = grouped(spark, 100_000)
    return cut(own.createDataFrame(rows, schema).repartition(5, "g"))


def test_scans_of_whole_groups_equal_those_of_chunks(spark):
    rng = random.Random(5)
    rows = [(f"g{i % 7}", i, rng.choice("aab"), rng.choice([None, 1, 2, 5])) for i in range(300)]
    schema = "g string, ord long, v string, n long"
    found = []
    for df in (spark.createDataFrame(rows, schema), _dealt(spark, rows, schema)):
        chunk = od.ordinal_chunk("ord", 11)
        got = od.neighbours(df, ["g"], ["ord"], chunk, prev={"p": "n"}, next={"x": "v"}, prev2={"pp": "ord"}, first={"f": "ord"}, known={"k": F.col("n")})
        got = od.islands(got, ["g"], ["ord"], chunk, lambda row, before: row["v"] != before["v"], "isle")
        got = od.running_sums(got, ["g"], ["ord"], chunk, {"s": F.col("n"), "c": F.lit(1)}, {"t": "s"})
        got = od.running_max(got, ["g"], ["ord"], chunk, F.col("n"), "m")
        found.append(sorted(map(str, (r.asDict() for r in got.collect()))))
    assert found[0] == found[1]


def test_searches_of_whole_groups_equal_the_others(spark, monkeypatch):
    monkeypatch.setattr(nw, "SETTLED_ROUNDS", 1)
    rng = random.Random(9)
    steps = [(f"g{i % 6}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice([1, 1, 2, 7]), f"e{i}") for i in range(110)]
    steps += [("long", f"n{i}", f"n{i + 1}", 1, f"l{i}") for i in range(12)]
    found = []
    for whole in (False, True):
        make = (lambda rows, schema: _dealt(spark, rows, schema)) if whole else spark.createDataFrame
        edges = make(steps, "g string, src string, dst string, cost long, edge_id string")
        tree = cut(nw.shortest_tree(edges, make([(f"g{i}", "n0") for i in range(6)] + [("long", "n0")], "g string, source string"), ["g"]))
        asked = tree.select(F.concat("g", "node").alias("route_id"), "g", "source", F.col("node").alias("target"))
        walked = nw.path_steps(tree, asked, ["g"])
        found.append((sorted(map(str, tree.select("g", "source", "node", "cost", "hops", "pred", "edge_id").collect())), sorted(map(str, walked.collect()))))
    assert found[0] == found[1]


def test_floors_are_dealt_once(spark):
    load_all()
    tables, hops = walks.walk_tables(Tables(spark, FOLDER))
    assert whole_groups(hops)
    for df in (rt.graph_violations(tables), rt.joined_edges(tables)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_ring" not in line]
        assert not wide, wide
    assert not rt.joined_edges(tables)._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_a_floor_of_many_hops_is_not_one_task(spark, monkeypatch):
    load_all()
    monkeypatch.setattr(walks, "CHUNK_ROWS", 3)
    tables, hops = walks.walk_tables(Tables(spark, FOLDER))
    assert not whole_groups(hops)
    few = load_all()["gr_floor_faults"].build(spark, FOLDER)
    monkeypatch.undo()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, load_all()["gr_floor_faults"].build(spark, FOLDER).collect()))
