"""Reading bundles from files, the contract on a sound bundle, and one mutation per rule."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from concourse.operators import contract as ct
from concourse.operators import relational as rl
from concourse.sources import artifacts as ar
from concourse.sources import bundles as bu
from concourse.sources.sinks import canonical_rows, write_stable


def both(text):
    return {"en": text, "ar": text}


def evidence():
    return [{"source": "plan", "page": 1, "note": "drawn", "status": "candidate"}]


def room(key, x, **over):
    ring = [[x, 0], [x + 10, 0], [x + 10, 10], [x, 10]]
    return {
        "id": key, "code": key.upper(), "buildingId": "B1", "floorId": "GF", "name": both(key), "category": "office", "polygon": ring,
        "geometryRef": f"ref:{key}", "centroid": [x + 5, 5], "doorNodeId": None, "aliases": [key], "contentRef": key, "public": True,
        "geometryStatus": "candidate", "provenance": evidence(), **over,
    }


def sound():
    nodes = [
        {"id": "n1", "buildingId": "B1", "floorId": "GF", "point": [5, 15], "type": "junction", "status": "candidate", "roomId": "r1"},
        {"id": "n2", "buildingId": "B1", "floorId": "GF", "point": [25, 15], "type": "junction", "status": "candidate"},
    ]
    edge = {
        "id": "e1", "from": "n1", "to": "n2", "floorId": "GF", "pathType": "corridor", "distance": 20, "distanceUnit": "map-unit",
        "accessibility": "unknown", "restriction": "unknown", "status": "candidate", "bidirectional": True, "geometry": [[5, 15], [25, 15]],
    }
    floor = {
        "schemaVersion": 1,
        "building": {"id": "B1", "name": both("One"), "floorIds": ["GF"]},
        "floor": {
            "id": "GF", "buildingId": "B1", "name": both("Ground"), "level": 0, "viewBox": [0, 0, 100, 50], "mapAsset": "/maps/B1/GF/master.svg",
            "metersPerUnit": None, "calibrationStatus": "unknown",
        },
        "rooms": [room("r1", 0, doorNodeId="n1"), room("r2", 20, polygon=None, geometryRef=None, geometryStatus="unknown")],
        "kiosks": [{"id": "k", "buildingId": "B1", "floorId": "GF", "name": both("Kiosk"), "nodeId": None, "status": "unknown"}],
        "mapFeatures": [
            {
                "id": "f", "buildingId": "B1", "floorId": "GF", "name": both("Lift"), "kind": "elevator", "polygon": [[60, 5], [70, 5], [70, 9]],
                "geometryStatus": "candidate", "accessibility": "unknown", "connectedFloorIds": ["GF"], "provenance": evidence(),
            }
        ],
        "navigationDefaults": {"startRoomId": "r1"},
    }
    graph = {
        "routingPolicy": "drawing-based", "metersPerUnit": None, "calibrationStatus": "unknown", "status": "candidate",
        "navigableAreas": [[[0, 12], [50, 12], [50, 18], [0, 18]]], "walls": [[[0, 11], [50, 11]]], "nodes": nodes, "edges": [edge],
    }
    content = [{"id": key, "description": both("text"), "placeholder": True, "image": None, "imageAlt": both("none")} for key in ("r1", "r2")]
    return {"floor": floor, "graph": graph, "content": content}


def _set(path, value):
    def mutate(bundle):
        *way, last = path
        target = bundle
        for step in way:
            target = target[step]
        if value is DELETE:
            del target[last]
        else:
            target[last] = value

    return mutate


DELETE = object()
E, N, R0, FL = ("graph", "edges", 0), ("graph", "nodes", 0), ("floor", "rooms", 0), ("floor", "floor")
off = {"status": "unavailable", "reason": both("Closed")}
MUTATIONS = [
    ("R01", _set(("floor", "schemaVersion"), 2)),
    ("R02", _set((*FL, "id"), "G F")),
    ("R03", _set((*FL, "name", "ar"), " ")),
    ("R04", _set(("floor", "building", "floorIds"), ["F1"])),
    ("R04", _set(("floor", "building", "floorIds"), ["GF", "GF"])),
    ("R05", _set((*FL, "mapAsset"), "/maps/../../master.svg")),
    ("R06", _set((*FL, "viewBox"), [0, 0, 0, 50])),
    ("R07", _set((*FL, "metersPerUnit"), 1)),
    ("R08", _set((*R0, "centroid"), [5, 500])),
    ("R09", _set(("floor", "rooms", 1, "id"), "r1")),
    ("R09", _set(("floor", "rooms", 1, "code"), "R1")),
    ("R10", _set(("floor", "mapFeatures", 0, "kind"), "ramp")),
    ("R10", _set(("floor", "mapFeatures", 0, "connectedFloorIds"), ["F9"])),
    ("R11", _set(("floor", "navigationDefaults"), {"startRoomId": "missing"})),
    ("R12", _set((*R0, "name", "ar"), DELETE)),
    ("R12", _set((*R0, "buildingId"), "UNKNOWN")),
    ("R12", _set((*R0, "centroid"), [None, 5])),
    ("R13", _set((*R0, "navigationPartial"), True)),
    ("R14", _set((*R0, "availability"), {**off, "status": "maintenance"})),
    ("R14", _set((*R0, "availability"), {**off, "reason": {"ar": "مغلقة"}})),
    ("R14", _set((*R0, "availability"), {**off, "reason": {"en": "Closed"}})),
    ("R14", _set((*R0, "availability"), {**off, "roomId": "missing"})),
    ("R14", _set((*R0, "availability"), {**off, "reason": {"en": "", "ar": "متاحة"}})),
    ("R15", _set((*R0, "polygon"), [[1, 1], [2, 2], [3, 3]])),
    ("R15", _set((*R0, "polygon"), [[0, 0], [10, 10], [10, 0], [0, 10]])),
    ("R15", _set((*R0, "polygon"), [[0, 0], [10, 0], [10, 0], [10, 10], [0, 10]])),
    ("R16", _set((*R0, "centroid"), [30, 30])),
    ("R17", _set((*R0, "geometryRef"), None)),
    ("R18", _set((*R0, "aliases"), DELETE)),
    ("R19", _set((*R0, "contentRef"), "missing")),
    ("R19", _set(("content", 0, "placeholder"), DELETE)),
    ("R20", _set((*R0, "provenance"), [])),
    ("R20", _set((*R0, "provenance", 0, "page"), 1.5)),
    ("R21", _set(("graph", "routingPolicy"), "anything-goes")),
    ("R21", _set(("graph", "navigableAreas"), [])),
    ("R22", _set(("graph", "calibrationStatus"), "candidate")),
    ("R23", _set(("graph", "walls", 0), [[1, 2]])),
    ("R24", _set((*N, "roomId"), "missing")),
    ("R24", _set((*N, "type"), "hatch")),
    ("R25", _set((*R0, "doorNodeId"), "missing")),
    ("R26", _set((*N, "status"), "confirmed")),
    ("R27", _set(("floor", "kiosks", 0, "status"), "confirmed")),
    ("R28", _set((*E, "from"), "missing")),
    ("R29", _set((*E, "floorId"), "F9")),
    ("R30", _set((*E, "geometry", 0), [0, 0])),
    ("R31", _set((*E, "distance"), 120)),
    ("R32", _set((*E, "distanceUnit"), "meter")),
    ("R33", _set((*E, "status"), "confirmed")),
    ("R34", _set(("graph", "navigableAreas"), [])),
    ("R35", _set(("graph", "walls", 0), [[10, 10], [10, 20]])),
    ("R35", _set(("graph", "navigableAreas", 0), [[0, 12], [20, 12], [20, 18], [0, 18]])),
    ("R36", _set(("graph", "status"), "confirmed")),
]


def parsed(spark, bundles):
    rows = [(k, json.dumps(v["floor"]), json.dumps(v["graph"]), json.dumps(v["content"])) for k, v in bundles.items()]
    docs = bu.parse_documents(spark.createDataFrame(rows, "bundle_id string, floor_json string, graph_json string, content_json string"))
    return {name: df.cache() for name, df in bu.tables(docs.cache()).items()}


@pytest.fixture(scope="module")
def violations(spark):
    bundles = {"sound": sound()}
    for i, (_, mutate) in enumerate(MUTATIONS):
        bundles[str(i)] = copy.deepcopy(sound())
        mutate(bundles[str(i)])
    found = {key: set() for key in bundles}
    for r in ct.Contract(parsed(spark, bundles)).admission().collect():
        found[r.bundle_id].add(r.rule_id)
    return found


def test_sound_bundle_passes(violations):
    assert violations["sound"] == set()


@pytest.mark.parametrize("i", range(len(MUTATIONS)), ids=[f"{i}-{rule}" for i, (rule, _) in enumerate(MUTATIONS)])
def test_mutation_is_found(violations, i):
    assert MUTATIONS[i][0] in violations[str(i)]


def test_registry_rules(spark):
    other = sound()
    other["floor"]["building"]["floorIds"] = ["GF", "F1"]
    found = ct.Contract(parsed(spark, {"a": sound(), "b": other})).registry()
    got = {(r.path, r.message) for r in found.collect()}
    assert got == {
        ("B1/GF", "floor registered twice"), ("k", "kiosk registered twice"), ("B1", "building recorded differently"), ("B1/F1", "declared floor is missing"),
    }


def test_inventory_and_endpoints(spark):
    claimed = sound()
    claimed["graph"]["edges"][0]["accessibility"] = "confirmed"
    outside = sound()
    outside["graph"]["nodes"][0]["point"] = [5, 30]
    c = ct.Contract(parsed(spark, {"claimed": claimed, "outside": outside}))
    assert [r.bundle_id for r in c.inventory().collect()] == ["claimed"]
    assert [(r.bundle_id, r.path) for r in c.endpoints().collect()] == [("outside", "n1")]


def test_read_bundles_from_files(spark, tmp_path):
    b = sound()
    place, content = tmp_path / "data/buildings/B1", tmp_path / "content/B1"
    place.mkdir(parents=True)
    content.mkdir(parents=True)
    (place / "GF.json").write_text(json.dumps(b["floor"], indent=2))
    (place / "GF.graph.json").write_text(json.dumps(b["graph"], indent=2))
    (place / "GF.review.json").write_text("{}")
    (place / "GF.shortest-paths.review.json").write_text("{}")
    (content / "GF.json").write_text(json.dumps(b["content"], indent=2))
    root = str(tmp_path)
    assert [(r.path_building, r.path_floor) for r in bu.discover(spark, root).collect()] == [("B1", "GF")]
    t = bu.read_bundles(spark, root)
    assert [r.id for r in t["places"].orderBy("ord").collect()] == ["r1", "r2"]
    assert t["edges"].first().path[1].x == 25.0 and t["floors"].first().bundle_id == "B1/GF"
    assert ct.validate(t).isEmpty()
    requests = spark.createDataFrame([("q1", "nowhere", "B1", "GF"), ("q2", None, "B1", "GF")], "request_id string, kiosk_id string, building_id string, floor_id string")
    overrides = spark.createDataFrame([("a", "closed-for-good", ("x", "y"))], "code string, status string, reason struct<en:string,ar:string>")
    anchors = spark.createDataFrame([(1, 0.0), (2, 1e9)], "anchor_id long, residual double")
    beside = ct.validate(t, requests=requests, overrides=overrides, anchors=anchors, inventory=True)
    got = {(r.rule_id, r.path) for r in beside.filter("rule_id <> 'R43'").collect()}
    assert got == {("R38", "q1"), ("R41", "a"), ("R42", "2")}
    docs = bu.read_documents(spark, root).select("path_building", "path_floor", "doc.building.id", F.lit("F1").alias("floor"))
    assert bu.path_id_mismatches(docs, [("path_building", "id")]).isEmpty()
    assert bu.path_id_mismatches(docs, [("path_floor", "floor")]).count() == 1


def test_manifest_and_assets(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.svg").write_text('<svg viewBox="0, 0 10 20.000001"><path/></svg>')
    (tmp_path / "sub/b.svg").write_text('<svg viewBox="0 0 1"><image href="x"/></svg>')
    files = ar.read_artifacts(spark, str(tmp_path))
    digest = hashlib.sha256((tmp_path / "a.svg").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("a.svg", digest), ("sub/b.svg", "0"), ("c.svg", "0")], "name string, digest string")
    assert {(r.name, r.change) for r in rl.manifest_diff(files, manifest).collect()} == {("sub/b.svg", "changed"), ("c.svg", "removed")}
    assets = files.select(F.col("name").alias("asset_id"), F.decode("content", "utf-8").alias("body"))
    floors = spark.createDataFrame([("a.svg", [0.0, 0.0, 10.0, 20.0]), ("sub/b.svg", [0.0, 0.0, 1.0, 1.0])], "asset_id string, view_box array<double>")
    got = {(r.asset_id, r.rule) for r in ar.asset_violations(assets, floors).collect()}
    assert got == {("sub/b.svg", "view box differs"), ("sub/b.svg", "embedded image or script")}


def test_stable_output_repeats(spark, tmp_path):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("v"), F.when(F.col("id") > 5, F.lit("x")).alias("t"))
    texts = []
    for name in ("one", "two"):
        write_stable(df.repartition(5) if name == "two" else df, str(tmp_path / name), ["id"])
        texts.append("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
    assert texts[0] == texts[1] and texts[0].startswith('{"id":0,"t":null,"v":0}')
    assert [r.record for r in canonical_rows(df.select("v")).collect()] == [f'{{"v":{i}}}' for i in range(7)]
