"""Synthetic floor graphs for routing tests, in the normalised table layout."""

from __future__ import annotations

import math

NODE = "bundle_id string, id string, buildingId string, floorId string, xy struct<x:double,y:double>, type string, roomId string, status string"
EDGE = (
    "bundle_id string, id string, `from` string, `to` string, floorId string, pathType string, distance double, distanceUnit string, "
    "accessibility string, restriction string, status string, bidirectional boolean, path array<struct<x:double,y:double>>"
)
GRAPH = "bundle_id string, policy string, meters_per_unit double, calibration_status string, status string, n_areas int, n_walls int"
AREA = "bundle_id string, ord int, ring array<struct<x:double,y:double>>"
WALL = "bundle_id string, ord int, path array<struct<x:double,y:double>>"


def node(key, x, y, **over):
    return {"id": key, "buildingId": "B", "floorId": "F0", "xy": (float(x), float(y)), "type": "junction", "roomId": None, "status": "confirmed", **over}


def edge(a, z, **over):
    (ax, ay), (zx, zy) = a["xy"], z["xy"]
    return {
        "id": f"{a['id']}-{z['id']}", "from": a["id"], "to": z["id"], "floorId": a["floorId"], "pathType": "corridor",
        "distance": math.hypot(zx - ax, zy - ay), "distanceUnit": "map-unit", "accessibility": "confirmed", "restriction": "open",
        "status": "confirmed", "bidirectional": True, "path": [a["xy"], z["xy"]], **over,
    }


class Graph:
    def __init__(self, nodes, edges, **over):
        self.nodes, self.edges = nodes, edges
        self.areas, self.walls = over.pop("areas", []), over.pop("walls", [])
        self.facts = {"policy": None, "meters_per_unit": None, "calibration_status": "unknown", "status": "confirmed", **over}


def corner(**over):
    """a - b - c, the last one a door: ten right, then ten down."""
    a, b = node("a", 0, 0), node("b", 10, 0)
    c = node("c", 10, 10, type="door", roomId="room")
    return Graph([a, b, c], [edge(a, b), edge(b, c, pathType="door")], **over)


def corridor(**over):
    a, b = node("a", 0, 0), node("b", 10, 0)
    return Graph([a, b], [edge(a, b)], **{"areas": [box(-1, 11)], **over})


def drawing(**over):
    g = corner(policy="drawing-based", areas=[[(-1.0, -1.0), (11.0, -1.0), (11.0, 11.0), (-1.0, 11.0)]])
    g.facts["status"] = "candidate"
    for n in g.nodes:
        n["status"] = "candidate"
    for e in g.edges:
        e.update(status="candidate", restriction="unknown", accessibility="unknown")
    g.facts.update(over)
    return g


def box(left, right):
    return [(float(left), -1.0), (float(right), -1.0), (float(right), 1.0), (float(left), 1.0)]


def tables(spark, graphs: dict[str, Graph]):
    """All graphs side by side, so one Spark run answers many cases."""
    rows = {"nodes": [], "edges": [], "graphs": [], "areas": [], "walls": []}
    for key, g in graphs.items():
        rows["nodes"] += [(key, *[n[c] for c in ("id", "buildingId", "floorId", "xy", "type", "roomId", "status")]) for n in g.nodes]
        cols = ("id", "from", "to", "floorId", "pathType", "distance", "distanceUnit", "accessibility", "restriction", "status", "bidirectional", "path")
        rows["edges"] += [(key, *[e[c] for c in cols]) for e in g.edges]
        f = g.facts
        rows["graphs"].append((key, f["policy"], f["meters_per_unit"], f["calibration_status"], f["status"], len(g.areas), len(g.walls)))
        rows["areas"] += [(key, i, a) for i, a in enumerate(g.areas)]
        rows["walls"] += [(key, i, w) for i, w in enumerate(g.walls)]
    schemas = {"nodes": NODE, "edges": EDGE, "graphs": GRAPH, "areas": AREA, "walls": WALL}
    return {name: spark.createDataFrame(rows[name], schemas[name]) for name in rows}
