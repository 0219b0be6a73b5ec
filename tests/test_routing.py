"""Route statuses, costs, points and instructions; all cases run as one batch of graphs."""

from __future__ import annotations

import math

import pytest

from concourse.operators import routing as rt
from concourse.operators.instructions import instructions
from tests.floors import Graph, box, corner, corridor, drawing, edge, node, tables

NAN, INF = float("nan"), float("inf")
CASES: dict[str, tuple[Graph, str | None, str | None, bool]] = {}
EXPECT: dict[str, dict] = {}


def case(key, graph, start="a", end="c", accessible=False, **expect):
    CASES[key] = (graph, start, end, accessible)
    EXPECT[key] = expect


def changed(graph, **edits):
    """Apply edits like ``edges_0_status='unknown'`` to a graph."""
    for path, value in edits.items():
        kind, index, field = path.split("_", 2)
        getattr(graph, kind)[int(index)][field] = value
    return graph


case("corner", corner(), status="ok", distance=20.0, points=[(0, 0), (10, 0), (10, 10)], types=["start", "destination-right", "arrival"])
case("back", corner(), "c", "a", status="ok", points=[(10, 10), (10, 0), (0, 0)])
case("one way", changed(corner(), edges_1_bidirectional=False), "c", "a", status="unavailable", reason="disconnected")
scaled = corner(calibration_status="confirmed", meters_per_unit=0.1)
scaled.edges.append(edge(scaled.nodes[0], scaled.nodes[2], id="short", distance=3.0, distanceUnit="meter"))
case("metric long", scaled, status="ok", distance=2.0, unit="meter", edges=["a-b", "b-c"])
scaled = corner(calibration_status="confirmed", meters_per_unit=0.1)
scaled.edges.append(edge(scaled.nodes[0], scaled.nodes[2], id="short", distance=1.0, distanceUnit="meter"))
case("metric short", scaled, status="ok", distance=1.0, edges=["short"])
for status in ("candidate", "unknown"):
    case(f"{status} scale", corner(calibration_status=status, meters_per_unit=0.5), status="ok", distance=20.0, unit="map-unit")
    case(
        f"{status} scale metres",
        changed(corner(calibration_status=status, meters_per_unit=0.5), edges_0_distanceUnit="meter"),
        status="invalid", unit="map-unit",
    )
    case(f"{status} graph", corner(status=status), status="ok")
    case(f"{status} graph edge", changed(corner(status=status), edges_0_status=status), status="unconfirmed")
    case(f"{status} empty", Graph([], [], status=status), status="unconfirmed")
    case(f"{status} start", changed(corner(), nodes_0_status=status), status="unconfirmed")
    case(f"{status} middle", changed(corner(), nodes_1_status=status), status="unavailable")
    case(f"{status} edge", changed(corner(), edges_0_status=status), status="unavailable")
for value in ("closed", "unknown"):
    case(f"{value} edge access", changed(corner(), edges_0_restriction=value), status="unavailable")
for value in ("unknown", "inaccessible"):
    case(f"{value} walk", changed(corner(), edges_0_accessibility=value), status="ok")
    case(f"{value} step-free", changed(corner(), edges_0_accessibility=value), accessible=True, status="unavailable", reason="accessible")
case("stairs step-free", changed(corner(), edges_0_pathType="stairs"), accessible=True, status="unavailable")


def lifted():
    a, b, c = node("a", 0, 0), node("b", 1000, 0, floorId="F1"), node("c", 1, 0)
    return Graph(
        [a, b, c],
        [edge(a, c, distance=5.0), edge(a, b, pathType="elevator", distance=1.0), edge(b, c, pathType="elevator", distance=1.0, floorId="F1")],
    )


case("lift", lifted(), accessible=True, status="ok", distance=2.0, nodes=["a", "b", "c"])
case("lift blocked", changed(lifted(), edges_1_accessibility="unknown"), accessible=True, status="ok", nodes=["a", "c"])
case("same node", corner(), "a", "a", status="ok", distance=0.0, nodes=["a"], edges=[], types=["start", "arrival"])
case("free edges", changed(corner(), edges_0_distance=0.0, edges_1_distance=0.0), status="ok", distance=0.0, nodes=["a", "b", "c"])
case("no start", corner(), None, "c", status="unavailable", reason="start")
case("no end", corner(), "a", None, status="unavailable", reason="destination")
case("missing", corner(), "gone", "c", status="invalid", reason="missing")
case("cut off", Graph(corner().nodes, []), status="unavailable", reason="disconnected")
for value in (-1.0, NAN, INF):
    case(f"weight {value}", changed(corner(), edges_0_distance=value), status="invalid")
for value in (0.0, -1.0, NAN, INF, None):
    case(f"scale {value}", corner(calibration_status="confirmed", meters_per_unit=value), status="invalid")
case("loose geometry", changed(corner(), edges_0_path=[(1.0, 1.0), (10.0, 0.0)]), status="invalid")
case("floor change", changed(corner(), nodes_1_floorId="F9"), status="invalid")
twice = corner()
twice.edges.append(dict(twice.edges[0]))
case("repeated edge", twice, status="invalid")
for i, wall in enumerate([[(5, -1), (5, 1)], [(5, 0), (5, 1)], [(3, 0), (7, 0)], [(0, -1), (0, 1)]]):
    case(f"wall {i}", corridor(walls=[[(float(x), float(y)) for x, y in wall]]), "a", "b", status="invalid")
case("opening", corridor(walls=[[(5.0, -2.0), (5.0, -0.5)], [(5.0, 0.5), (5.0, 2.0)]]), "a", "b", status="ok")
case("islands", corridor(areas=[box(-1, 1), box(4, 6), box(9, 11)]), "a", "b", status="invalid")
case("touching areas", corridor(areas=[box(-1, 5), box(5, 11)]), "a", "b", status="ok")
case("along boundary", corridor(areas=[[(0.0, 0.0), (10.0, 0.0), (10.0, 1.0), (0.0, 1.0)]]), "b", "a", status="ok")
notch = [(-1, -1), (11, -1), (11, 1), (7, 1), (7, -0.5), (6, -0.5), (6, 1), (-1, 1)]
case("notch", corridor(areas=[[(float(x), float(y)) for x, y in notch]]), "a", "b", status="invalid")
outside = corridor(areas=[box(4, 6)])
outside.edges = []
case("outside node", outside, "a", "a", status="invalid")
case("other floor edge", changed(corridor(), edges_0_floorId="F7"), "a", "b", status="invalid")
case("two floors fenced", changed(corridor(), nodes_1_floorId="F1", edges_0_pathType="elevator"), "a", "b", status="invalid")
case("two floors open", changed(corridor(areas=[]), nodes_1_floorId="F1", edges_0_pathType="elevator"), "a", "b", status="ok")
case("two floors stray", changed(corridor(areas=[]), nodes_1_floorId="F1", edges_0_pathType="elevator", edges_0_floorId="F7"), "a", "b", status="invalid")
case("flat area", corridor(areas=[[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]), "a", "b", status="invalid")
case("bad wall", corridor(areas=[], walls=[[(NAN, 0.0), (1.0, 1.0)]]), "a", "b", status="invalid")
case("drawing", drawing(), status="ok", distance=20.0, unit="map-unit")
case("drawing step-free", drawing(), accessible=True, status="unavailable")
case("drawing step-free ok", changed(drawing(), edges_0_accessibility="confirmed", edges_1_accessibility="confirmed"), accessible=True, status="ok")
case("drawing closed", changed(drawing(), edges_0_restriction="closed"), status="unavailable")
case("drawing verified", drawing(policy="verified-only"), status="unconfirmed")
bare = drawing()
bare.areas = []
case("drawing bare", bare, status="invalid")
case("drawing bad point", changed(drawing(), nodes_0_xy=(INF, 0.0)), status="invalid")
case("drawing false weight", changed(drawing(), edges_0_distance=1.0), status="invalid")
case("drawing policy", drawing(policy="anything-goes"), status="invalid")
case("drawing unknown node", changed(drawing(), nodes_0_status="unknown"), status="unconfirmed")
case("drawing unknown edge", changed(drawing(), edges_0_status="unknown"), status="unavailable")
walled = drawing()
walled.walls = [[(5.0, -1.0), (5.0, 1.0)]]
case("drawing wall", walled, status="invalid")

for angle, kind in [
    (0, "continue"), (14.99, "continue"), (-14.99, "continue"), (15, "slight-right"), (-15, "slight-left"), (44.99, "slight-right"),
    (-44.99, "slight-left"), (45, "right"), (-45, "left"), (90, "right"), (-90, "left"),
]:
    r = math.radians(angle)
    a, b, c = node("a", 0, 0), node("b", 10, 0), node("c", 10 + 10 * math.cos(r), 10 * math.sin(r))
    case(f"angle {angle}", Graph([a, b, c], [edge(a, b), edge(b, c)]), status="ok", types=["start", kind, "arrival"])
    if angle == 90:
        case("angle mirrored", Graph([a, b, c], [edge(a, b), edge(b, c)]), "c", "a", status="ok", types=["start", "left", "arrival"])
left = changed(corner(), nodes_2_xy=(10.0, -10.0), edges_1_path=[(10.0, 0.0), (10.0, -10.0)])
case("left door", left, status="ok", types=["start", "destination-left", "arrival"], ar="وجهتك على اليسار.")
plain = changed(corner(), nodes_2_xy=(10.0, -10.0), edges_1_path=[(10.0, 0.0), (10.0, -10.0)], edges_1_pathType="corridor")
case("left turn", plain, status="ok", types=["start", "left", "arrival"])
case("from entrance", changed(corner(), nodes_0_type="entrance"), "a", "b", status="ok", types=["start", "enter-corridor", "arrival"])
a, b, c = node("a", 0, 0), node("b", 10, 10), node("c", 20, 10)
bent = Graph([a, b, c], [edge(a, b, path=[(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 10.0)], distance=20.0), edge(b, c)])
case("bends", bent, status="ok", types=["start", "right", "left", "arrival"])
case("bends back", bent, "c", "a", status="ok", types=["start", "right", "left", "arrival"])
for kind in ("stairs", "elevator"):
    a, b, c = node("a", 0, 0), node("b", 0, 0, floorId="F1"), node("c", 10, 0, floorId="F1")
    up = Graph([a, b, c], [edge(a, b, pathType=kind, distance=5.0), edge(b, c)])
    case(f"{kind} up", up, status="ok", types=["start", kind, "continue", "arrival"], names_floor="F1")
    case(f"{kind} down", up, "b", "a", status="ok", types=["start", kind, "arrival"], names_floor="F0")
chain = [node(str(i), i, 0) for i in range(30)] + [node("end", 29, 10)]
case(
    "straight chain", Graph(chain, [edge(p, q) for p, q in zip(chain, chain[1:])]), "0", "end",
    status="ok", types=["start", "continue", "right", "arrival"], n_points=31, second_distance=28.0,
)


@pytest.fixture(scope="module")
def outcome(spark):
    t = tables(spark, {key: g for key, (g, *_) in CASES.items()})
    asked = spark.createDataFrame(
        [(key, key, start, end, acc) for key, (_, start, end, acc) in CASES.items()],
        "route_id string, bundle_id string, start_node string, end_node string, accessible boolean",
    )
    result, path = rt.route_requests(asked, t)
    path = path.cache()
    found = {r.route_id: r.asDict() for r in result.collect()}
    for row in found.values():
        row.update(nodes=[row["start_node"]] if row["status"] == "ok" else [], edges=[], points=[], types=[], rows=[])
    for r in path.orderBy("route_id", "ord").collect():
        found[r.route_id]["nodes"].append(r.to_node)
        found[r.route_id]["edges"].append(r.edge_id)
    for r in rt.route_points(path).orderBy("route_id", "ord", "sub").collect():
        found[r.route_id]["points"].append((r.x, r.y))
    ok = result.filter("status = 'ok'").select("route_id", "start_node")
    for r in instructions(path, ok).orderBy("route_id", "ord", "sub").collect():
        found[r.route_id]["types"].append(r.type)
        found[r.route_id]["rows"].append(r)
    return found


@pytest.mark.parametrize("key", list(CASES))
def test_route(outcome, key):
    row, want = outcome[key], EXPECT[key]
    for field in ("status", "reason", "unit", "nodes", "edges", "types"):
        if field in want:
            assert row[field] == want[field], (field, row)
    if "distance" in want:
        assert row["distance"] == pytest.approx(want["distance"])
    if "points" in want:
        assert row["points"] == [tuple(map(float, p)) for p in want["points"]]
    if "n_points" in want:
        assert len(row["points"]) == want["n_points"]
    if "second_distance" in want:
        assert row["rows"][1].distance == want["second_distance"]
    if "names_floor" in want:
        assert want["names_floor"] in row["rows"][1].text_en and want["names_floor"] in row["rows"][1].text_ar
    if "ar" in want:
        assert row["rows"][1].text_ar == want["ar"]
    if row["status"] == "ok":
        assert row["reason"] is None and all(r.text_en and r.text_ar for r in row["rows"])
    else:
        assert row["reason_en"] and row["reason_ar"] and not row["types"]


def test_supplied_paths(spark):
    graph = changed(corner(), edges_0_bidirectional=False)
    steps = rt.steps_of(tables(spark, {"g": graph}))
    claims = [
        ("good", ["a", "b", "c"], ["a-b", "b-c"]), ("short", ["a"], []), ("empty", [], []), ("gap", ["a", "c"], ["a-b"]),
        ("swapped", ["a", "b", "c"], ["b-c", "a-b"]), ("reversed", ["b", "a"], ["a-b"]), ("unknown", ["z"], []),
    ]
    df = spark.createDataFrame(claims, "path_id string, nodes array<string>, edges array<string>")
    starts = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    assert {r.path_id for r in rt.valid_paths(df, steps, starts).collect()} == {"good", "short"}


def test_unusable_costs_fail_at_once(spark):
    from concourse.operators.network import shortest_tree

    for cost in (-1.0, float("nan"), None):
        steps = spark.createDataFrame([("a", "b", 1.0, "e1"), ("b", "a", cost, "e2")], "src string, dst string, cost double, edge_id string")
        with pytest.raises(Exception, match="unusable cost on edge e2"):
            shortest_tree(steps, spark.createDataFrame([("a",)], "source string"))


def test_nearest_pairs_ends_without_real_positions(spark):
    from concourse.operators.spatial import nearest_pairs

    a = spark.createDataFrame([("t", 1, 0.0, 0.0), ("t", 2, None, 0.0), ("u", 3, float("nan"), 1.0), ("far", 4, 0.0, 0.0)], "anchor string, a_id long, ax double, ay double")
    z = spark.createDataFrame([("t", 8, None, None), ("t", 9, 3.0, 4.0), ("u", 7, 1.0, 1.0), ("far", 6, 1e6, 0.0), ("far", 5, 1e6 + 1, 0.0)], "anchor string, z_id long, zx double, zy double")
    got = {r["anchor"]: (r["a_id"], r["z_id"], r["residual"]) for r in nearest_pairs(a, z, 0, 0).collect()}
    assert got == {"t": (1, 9, 5.0), "far": (4, 6, 1e6)}
