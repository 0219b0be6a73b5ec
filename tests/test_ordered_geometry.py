"""Chunked scans against plain windows, rounding, linear referencing and spatial joins against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.operators import linear as ln
from concourse.operators import measures as ms
from concourse.operators import network as nw
from concourse.operators import ordered as od
from concourse.operators import sequences as sq
from concourse.operators import spatial as sp


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows, and chunks are tiny."""
    rng = random.Random(1)
    rows = [("hot" if i % 4 else f"k{i % 7}", i, rng.choice([None, float(rng.randint(0, 9))])) for i in range(2000)]
    return spark.createDataFrame(rows, "key string, ord long, v double").cache()


def test_scans_equal_windows(skewed):
    chunk = od.ordinal_chunk("ord", 16)
    w = Window.partitionBy("key").orderBy("ord")
    got = od.neighbours(skewed, ["key"], ["ord"], chunk, prev={"p": "v", "po": "ord"}, next={"n": "v"})
    got = od.running_sum(got, ["key"], ["ord"], chunk, F.col("v"), "s", total="t")
    got = od.row_numbers(got, ["key"], ["ord"], chunk, "rn")
    got = od.last_known(got, ["key"], ["ord"], chunk, F.col("v"), "l")
    zero = F.lit(0.0)
    want = skewed.select(
        "key", "ord", "v", F.lag("v").over(w).alias("p"), F.lag("ord").over(w).alias("po"), F.lead("v").over(w).alias("n"),
        F.coalesce(F.sum("v").over(w), zero).alias("s"), F.coalesce(F.sum("v").over(Window.partitionBy("key")), zero).alias("t"),
        F.row_number().over(w).cast("long").alias("rn"), F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("l"),
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_first_and_top(skewed):
    w = Window.partitionBy("key").orderBy("ord")
    first = od.first_per(skewed, ["key"], ["ord"])
    want = skewed.withColumn("rn", F.row_number().over(w))
    assert first.exceptAll(want.filter("rn = 1").drop("rn")).isEmpty()
    top = od.top_k(skewed, ["key"], [F.col("ord")], 5, ["ord"]).select("key", "ord", "rank")
    assert {tuple(r) for r in top.collect()} == {tuple(r) for r in want.filter("rn <= 5").select("key", "ord", "rn").collect()}


def test_round_half_even(spark):
    rng = random.Random(2)
    values = [2.675, 1.005, 0.12345, 0.5, 1.5, -2.5, -0.125, 1e-9] + [rng.uniform(-4000, 4000) for _ in range(500)]
    values += [rng.randint(-99999, 99999) / 2 ** rng.randint(1, 8) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (5, 4, 3, 1):
        for r in df.select("v", g.round_half_even(F.col("v"), digits).alias("r")).collect():
            assert r.r == round(r.v, digits), (r.v, digits)


TRACKS = {
    "uneven": [(0, 0), (10, 0), (10, 90)], "repeat": [(2, 3), (2, 3)], "two": [(0, 0), (10, 0)], "one": [(4, 5)],
    "stutter": [(0, 0), (0, 0), (2, 0)], "broken": [(0, 0), (float("nan"), 1), (3, 4), (6, 8)],
}
CLIPS = [
    ("uneven", 0.5, [(0, 0), (10, 0), (10, 40)]), ("uneven", 1.0, TRACKS["uneven"]), ("uneven", 7.0, TRACKS["uneven"]), ("uneven", -1.0, [(0, 0)]),
    ("uneven", float("nan"), [(0, 0)]), ("uneven", 0.1, [(0, 0), (10, 0)]), ("repeat", 0.5, [(2, 3)]), ("repeat", 1.0, [(2, 3), (2, 3)]),
    ("two", 0.25, [(0, 0), (2.5, 0)]), ("one", 0.3, [(4, 5)]), ("stutter", 0.5, [(0, 0), (1, 0)]),
]


def track_table(spark):
    rows = [(k, i, float(x), float(y)) for k, pts in TRACKS.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "track string, ord long, x double, y double")


def test_clip_and_point(spark):
    v = track_table(spark)
    asked = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(CLIPS)], "request_id int, track string, t double")
    got = {}
    for r in ln.clip_track(v, asked, "track").orderBy("request_id", "ord", "part").collect():
        got.setdefault(r.request_id, []).append((r.x, r.y))
    ends = {r.request_id: (r.x, r.y) for r in ln.point_at(v, asked, "track").collect()}
    for i, (_, _, want) in enumerate(CLIPS):
        assert got[i] == [tuple(map(float, p)) for p in want], (i, got[i])
        assert ends[i] == pytest.approx(got[i][-1])


def test_lengths_and_durations(spark):
    v = track_table(spark)
    strict = {r.track: r.length for r in ms.polyline_length(v, "track").collect()}
    lenient = {r.track: r.length for r in ms.arc_length(v, "track").collect()}
    assert strict["uneven"] == 100 and strict["one"] == 0 and strict["broken"] != strict["broken"] and lenient["broken"] == 5
    lengths = spark.createDataFrame([(5.0,), (10000.0,), (350.0,)], "length double")
    times = [r.duration_ms for r in ln.traverse_ms(lengths).collect()]
    assert times == [900.0, 6000.0, pytest.approx(1000.0)]
    assert ln.traverse_ms(lengths, -1.0, float("nan"), 100.0).first().duration_ms == 900.0


def test_index_clamp(spark):
    cases = [(3.0, 2.0, 1), (-1.0, 2.0, 0), (1.9, 5.0, 1), (float("nan"), 5.0, 0), (2.0, 0.0, 0), (2.0, float("inf"), 0)]
    df = spark.createDataFrame(cases, "i double, n double, want long")
    assert all(r.got == r.want for r in df.withColumn("got", ln.clamp_index(F.col("i"), F.col("n"))).collect())


def test_bbox_join_equals_brute_force(spark):
    """Boxes of very different sizes, including a crowd in one place."""
    rng = random.Random(9)

    def boxes(n, name):
        rows = []
        for i in range(n):
            x, y = (0.5, 0.5) if i % 3 == 0 else (rng.uniform(-50, 50), rng.uniform(-50, 50))
            w, h = 10 ** rng.uniform(-2, 2), 10 ** rng.uniform(-2, 2)
            rows.append((i, x, y, x + w, y + h))
        cols = ", ".join(f"{name}{c} double" for c in ("x0", "y0", "x1", "y1"))
        return rows, spark.createDataFrame(rows, f"{name}id int, {cols}")

    a_rows, a = boxes(150, "a")
    b_rows, b = boxes(120, "b")
    col = lambda p: [F.col(p + c) for c in ("x0", "y0", "x1", "y1")]
    got = [(r.aid, r.bid) for r in sp.bbox_join(a, b, col("a"), col("b"), base=0.5).collect()]
    want = {(p[0], q[0]) for p in a_rows for q in b_rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_hull_of_skewed_points(spark):
    rng = random.Random(4)
    rows = [("hot", float(rng.randint(0, 40)), float(rng.randint(0, 40))) for _ in range(3000)] + [("line", float(i), 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {}
    for r in ms.convex_hull(df, "k").orderBy("k", "ord").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
    assert got["line"] == [(0.0, 0.0), (4.0, 0.0)]
    hull = got["hot"]
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for k, x, y in rows if k == "hot")


def test_chain_contraction(spark):
    """A long chain, a loop at a junction, and a ring without any stop."""
    chain = [(i, i + 1, 1.0) for i in range(0, 37)]
    loop = [(37, 100, 2.0), (100, 101, 2.0), (101, 37, 2.0)]
    ring = [(200, 201, 1.0), (201, 202, 1.0), (202, 200, 1.0)]
    links = spark.createDataFrame(chain + loop + ring, "from_node long, to_node long, length double")
    ends = spark.createDataFrame([(0,), (12,)], "node_id long")
    special = nw.special_vertices(links, ends)
    edges, vertices = nw.contract_chains(links, special)
    got = {(r.start_node, r.end_node, r.length, r.parts) for r in edges.collect()}
    assert got == {(0, 12, 12.0, 12), (12, 37, 25.0, 25), (37, 37, 6.0, 3)}
    walk = [r.vertex for r in vertices.filter("start_node = 12").orderBy("ord").collect()]
    assert walk == list(range(13, 38))


def test_fold_keeps_single_null(spark):
    rows = [("r", 0, "start", 1.0), ("r", 1, "continue", None), ("r", 2, "left", 2.0), ("r", 3, "continue", None), ("r", 4, "continue", 5.0)]
    df = spark.createDataFrame(rows, "route_id string, ord long, type string, distance double")
    got = sq.fold_continue(df, "route_id", ["ord"], od.ordinal_chunk("ord", 2)).orderBy("ord")
    assert [(r.type, r.distance) for r in got.collect()] == [("start", 1.0), ("continue", None), ("left", 2.0), ("continue", 5.0)]


def test_shortest_costs_equal_brute_force(spark):
    import heapq

    rng = random.Random(8)
    edges = [(f"e{i}", rng.randint(0, 40), rng.randint(0, 40), rng.randint(0, 9)) for i in range(160)]
    steps = spark.createDataFrame(edges, "edge_id string, src int, dst int, cost long")
    sources = spark.createDataFrame([(s,) for s in range(5)], "source int")
    got = {(r.source, r.node): r.cost for r in nw.shortest_costs(steps, sources).collect()}
    want = {}
    for s in range(5):
        queue, seen = [(0, s)], set()
        while queue:
            d, u = heapq.heappop(queue)
            if u in seen:
                continue
            seen.add(u)
            want[(s, u)] = d
            for _, a, z, c in edges:
                if a == u:
                    heapq.heappush(queue, (d + c, z))
    assert got == want


def test_contained_rooted_tree_is_worse(spark):
    """Negative control: a square ring loses one side when only the root's tree may be used."""
    sides = [("ab", "a", "b"), ("bc", "b", "c"), ("cd", "c", "d"), ("da", "d", "a")]
    edges = spark.createDataFrame([(k, p, q, 10) for k, p, q in sides] + [(k + "r", q, p, 10) for k, p, q in sides], "edge_id string, src string, dst string, cost long")
    ends = spark.createDataFrame([(n,) for n in "abcd"], "node_id string")
    root = spark.createDataFrame([("a",)], "node_id string")
    worse = {(r.start_node, r.end_node) for r in nw.tree_detours(edges, root, ends).filter("worse").collect()}
    assert worse == {("c", "d"), ("d", "c")} or worse == {("b", "c"), ("c", "b")}


def test_grid_keeps_out_of_holes_and_into_further_parts(spark):
    from concourse.operators import grid

    box = lambda x0, y0, x1, y1: ([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], x0, y0, x1, y1)
    # Domain 1: a part with a hole, an isle in the hole, a thin wall cut out between two columns, and a part of its own.
    rings = {1: [box(0.5, 0.5, 12.5, 12.5), box(2.5, 2.5, 9.5, 9.5), box(4.5, 4.5, 7.5, 7.5), box(10.4, 0.7, 10.6, 11.5), box(20.5, 0.5, 24.5, 4.5)], 2: [box(0.5, 0.5, 3.5, 3.5)]}
    rows = [(d, [{"x": x, "y": y} for x, y in ring], *map(float, b)) for d, of in rings.items() for ring, *b in of]
    domains = spark.createDataFrame(rows, "domain_id int, ring array<struct<x:double,y:double>>, min_x double, min_y double, max_x double, max_y double").repartition(3)
    inside = lambda d, x, y: sum(b[0] < x < b[2] and b[1] < y < b[3] for _, *b in rings[d]) % 2 == 1

    def gap(d, x, y):
        out = []
        for _, x0, y0, x1, y1 in rings[d]:
            dx, dy = max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1)
            out.append(math.hypot(dx, dy) if dx or dy else min(x - x0, x1 - x, y - y0, y1 - y))
        return min(out)

    want = {(d, x, y) for d in rings for x in range(26) for y in range(14) if inside(d, x, y)}
    cells = grid.clearance(grid.grid_cells(domains, 1.0), domains)
    got = {(r["domain_id"], r["ix"], r["iy"]): r["clearance"] for r in cells.collect()}
    assert set(got) == want
    assert all(abs(v - gap(*k)) < 1e-9 for k, v in got.items())
    links = {(r["domain_id"], r["ix0"], r["iy0"], r["ix1"], r["iy1"]) for r in grid.grid_links(cells, domains, 1.0).collect()}

    def stays(d, x, y, u, v):
        return all(inside(d, x + (u - x) * k / 1000, y + (v - y) * k / 1000) for k in range(1001))

    steps = [(d, x, y, x + i, y + j) for d, x, y in want for i, j in ((1, 0), (0, 1), (1, 1), (-1, 1)) if (d, x + i, y + j) in want]
    assert links == {s for s in steps if stays(*s)} and len(links) < len(steps)


def test_sequence_gaps(spark):
    from concourse.operators import relational as rl

    codes = spark.createDataFrame([(0, 1), (1, 2), (2, 4), (3, 4), (4, 200_000)], "ord long, number long")
    far = [(200_000, "unexpected")]
    shown = lambda last: sorted(map(tuple, rl.sequence_gaps(codes, last).filter("number < 6 or number > 139999").collect()))
    assert shown(0) == [(1, "unexpected"), (2, "unexpected"), (4, "unexpected"), *far]
    assert shown(3) == [(3, "missing"), (4, "unexpected"), *far]
    assert shown(spark.createDataFrame([(140_000,)], "last long")) == [(3, "missing"), (4, "repeated"), (5, "missing"), (140_000, "missing"), *far]
    assert rl.sequence_gaps(codes, 140_000).count() == 139_999
