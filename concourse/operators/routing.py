"""Route requests over floor graphs: health, eligibility, status ladder, paths and points.

Tables follow the bundle layout: ``graphs``, ``nodes``, ``edges``, ``areas`` and ``walls`` keyed by ``bundle_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.operators import network as nw
from concourse.operators.spatial import ring_box, points_in_polygons, segment_hits, uncovered_by_union
from concourse.session import cut, held, whole_groups

# Reasons shown when no route can be given.
REASONS = {
    "start": (
        "The starting point or kiosk location has not been confirmed. Choose a confirmed starting point.",
        "لم يتم تأكيد نقطة البداية أو موقع الكشك. اختر نقطة بداية مؤكدة.",
    ),
    "destination": ("The destination has no confirmed navigation point.", "لا توجد نقطة ملاحة مؤكدة للوجهة."),
    "unconfirmed": (
        "Navigation connections have not been confirmed. Directions are unavailable until the map is verified.",
        "لم يتم تأكيد وصلات الملاحة. لن تتوفر الاتجاهات حتى يتم التحقق من الخريطة.",
    ),
    "missing": (
        "The selected navigation point does not exist in this map.",
        "نقطة الملاحة المحددة غير موجودة في هذه الخريطة.",
    ),
    "invalid": (
        "Navigation data contains invalid geometry, distances, or calibration. A verified route cannot be calculated.",
        "تحتوي بيانات الملاحة على هندسة أو مسافات أو معايرة غير صالحة. لا يمكن حساب مسار موثوق.",
    ),
    "disconnected": ("No confirmed open route connects these points.", "لا يوجد مسار مفتوح ومؤكد يربط بين هاتين النقطتين."),
    "accessible": (
        "No route with confirmed step-free accessibility connects these points.",
        "لا يوجد مسار مؤكد الإتاحة وخالٍ من الدرج يربط بين هاتين النقطتين.",
    ),
}
POLICIES = (nw.VERIFIED, nw.DRAWING)
UNITS = ("map-unit", "meter")
VERTICAL = ("stairs", "elevator")
TOL = g.ROUTER


def _real_point(p: Column) -> Column:
    return g.is_finite(p["x"]) & g.is_finite(p["y"])


def _near(p: Column, q: Column) -> Column:
    return g.dist(p["x"], p["y"], q["x"], q["y"]) <= TOL.eps


def calibrated() -> Column:
    scale = F.col("meters_per_unit")
    return F.coalesce((F.col("calibration_status") == "confirmed") & g.is_finite(scale) & (scale > 0), F.lit(False))


def graph_facts(graphs: DataFrame) -> DataFrame:
    return graphs.select(
        "bundle_id",
        "policy",
        F.col("status").alias("graph_status"),
        "meters_per_unit",
        "calibration_status",
        calibrated().alias("metric"),
    )


def joined_edges(t: dict[str, DataFrame]) -> DataFrame:
    """Edges with their graph's facts and both end nodes (NULL structs where a node is missing)."""
    end = F.struct("id", "buildingId", "floorId", "xy", "type", "roomId", F.col("status").alias("status"))
    nodes = t["nodes"].select("bundle_id", F.col("id").alias("_id"), end.alias("_n"))
    if not t.get("nodes_are_unique"):
        nodes = nodes.dropDuplicates(["bundle_id", "_id"])
    a = nodes.select("bundle_id", F.col("_id").alias("from"), F.col("_n").alias("a"))
    z = nodes.select("bundle_id", F.col("_id").alias("to"), F.col("_n").alias("z"))
    return (
        t["edges"].join(held(graph_facts(t["graphs"])), "bundle_id").join(held(a), ["bundle_id", "from"], "left").join(held(z), ["bundle_id", "to"], "left")
    )


def _prepared(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Where groups lie whole, nodes are counted once by hash instead of sorted whenever edges look for their ends."""
    if not whole_groups(t["nodes"]) or "nodes_are_unique" in t:
        return t
    return {**t, "nodes_are_unique": _copies(t["nodes"]).isEmpty()}


def _copies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bundle_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def considered(edges: DataFrame) -> DataFrame:
    """Edges the policy looks at: usable evidence and a restriction it may pass."""
    return edges.filter(nw.evidence_ok("status", F.col("policy")) & nw.passable(F.col("policy")))


def _supported_ends() -> Column:
    def ok(end: str) -> Column:
        drawing = F.coalesce(F.col("policy"), F.lit(nw.VERIFIED)) == nw.DRAWING
        status = F.col(end)["status"]
        return (status == "confirmed") | (drawing & (status == "candidate"))

    return F.col("a").isNotNull() & F.col("z").isNotNull() & ok("a") & ok("z")


def usable(edges: DataFrame) -> DataFrame:
    """Considered edges between two supported nodes."""
    return considered(edges).filter(_supported_ends())


def _segments(edges: DataFrame) -> DataFrame:
    """Straight pieces of edge geometry with a key naming edge and piece within its graph."""
    spread = edges.select("bundle_id", F.col("id").alias("edge_id"), F.posexplode(g.path_sides(F.col("path"))).alias("piece", "s"))
    return spread.select(
        "bundle_id",
        F.struct("edge_id", "piece").alias("seg_key"),
        F.col("s.a.x").alias("ax"),
        F.col("s.a.y").alias("ay"),
        F.col("s.b.x").alias("bx"),
        F.col("s.b.y").alias("by_"),
    )


def _wall_segments(t: dict[str, DataFrame]) -> DataFrame:
    p, q = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    rows = t["walls"].select("bundle_id", F.col("ord").alias("wall_ord"), p["x"].alias("cx"), p["y"].alias("cy"), q["x"].alias("dx"), q["y"].alias("dy"))
    real = g.is_finite(F.col("cx")) & g.is_finite(F.col("cy")) & g.is_finite(F.col("dx")) & g.is_finite(F.col("dy"))
    return rows.filter(real)


def _areas(t: dict[str, DataFrame]) -> DataFrame:
    return ring_box(t["areas"].select("bundle_id", F.col("ord").alias("area_ord"), "ring")).filter("min_x is not null")


def unsafe_edges(edges: DataFrame, t: dict[str, DataFrame], tol: g.Tolerance = TOL, base: float = 1.0) -> DataFrame:
    """Edges whose geometry touches a wall or leaves the union of their graph's areas: bundle_id, edge_id, fault."""
    real = edges.filter(F.forall("path", _real_point))
    walls, areas = _wall_segments(t), _areas(t)
    bounded = walls.select("bundle_id").union(t["areas"].select("bundle_id")).distinct()
    seg = cut(_segments(real).join(held(bounded), "bundle_id", "left_semi"))
    edge = F.col("seg_key.edge_id").alias("edge_id")
    hits = segment_hits(seg, walls, tol, base, ["bundle_id"]).select("bundle_id", edge, F.lit("wall").alias("fault"))
    fenced = seg.join(held(t["areas"].select("bundle_id").distinct()), "bundle_id", "left_semi")
    out = uncovered_by_union(fenced, areas, "seg_key", ["area_ord"], tol, base, ["bundle_id"])
    left = out.select("bundle_id", edge, F.lit("outside").alias("fault"))
    return hits.unionByName(left).distinct()


def unsafe_nodes(nodes: DataFrame, t: dict[str, DataFrame], base: float = 1.0) -> DataFrame:
    """Nodes on a wall or outside the areas of their graph: bundle_id, node_id."""
    x, y = F.col("xy.x"), F.col("xy.y")
    spots = nodes.filter(_real_point(F.col("xy"))).select(
        "bundle_id", F.col("id").alias("node_id"), x.alias("ax"), y.alias("ay"), x.alias("bx"), y.alias("by_")
    )
    on_wall = segment_hits(spots, _wall_segments(t), TOL, base, ["bundle_id"]).select("bundle_id", "node_id")
    fenced = spots.join(held(t["areas"].select("bundle_id").distinct()), "bundle_id", "left_semi")
    inside = points_in_polygons(fenced, _areas(t), ["area_ord"], TOL, base, ["bundle_id"], xy=("ax", "ay")).select("bundle_id", "node_id")
    outside = fenced.select("bundle_id", "node_id").join(held(inside), ["bundle_id", "node_id"], "left_anti")
    return on_wall.unionByName(outside).distinct()


def graph_violations(t: dict[str, DataFrame], geometry: bool = True) -> DataFrame:
    """Every fault that makes a whole graph unusable for routing: bundle_id, element, fault.

    Edges the policy ignores are not examined; one faulty considered edge fails its graph.
    """
    from concourse.operators.contract import ring_faults

    t = _prepared(t)
    graphs = t["graphs"]
    drawing = F.coalesce(F.col("policy"), F.lit(nw.VERIFIED)) == nw.DRAWING

    def faults(df: DataFrame, element: Column, *rules: tuple[str, Column]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules]))
        return df.select("bundle_id", element.cast("string").alias("element"), F.explode(found).alias("fault"))

    parts = [
        faults(
            graphs,
            F.lit("graph"),
            ("unknown policy", F.col("policy").isNotNull() & ~F.col("policy").isin(*POLICIES)),
            ("bad calibration", (F.col("calibration_status") == "confirmed") & ~calibrated()),
            ("no areas", drawing & (F.coalesce("n_areas", F.lit(0)) < 1)),
        )
    ]
    for name in ("nodes", "edges"):
        parts.append(_copies(t[name]).select("bundle_id", F.col("id").alias("element"), F.lit(f"duplicate {name[:-1]}").alias("fault")))
    scoped = t["nodes"].join(held(graph_facts(graphs)), "bundle_id").filter(nw.evidence_ok("status", F.col("policy")))
    parts.append(faults(scoped, F.col("id"), ("bad point", ~F.coalesce(_real_point(F.col("xy")), F.lit(False)))))
    constrained = graphs.filter("n_areas > 0 or n_walls > 0").select("bundle_id")
    floors = scoped.join(held(constrained), "bundle_id", "left_semi").groupBy("bundle_id").agg(F.count_distinct("floorId").alias("n"))
    parts.append(floors.filter("n > 1").select("bundle_id", F.lit("graph").alias("element"), F.lit("unscoped constraints").alias("fault")))
    parts.append(
        faults(
            t["walls"],
            F.col("ord"),
            ("bad wall", (F.size("path") != 2) | ~F.coalesce(F.forall("path", _real_point), F.lit(False))),
        )
    )
    parts.append(ring_faults(t["areas"], TOL.eps, 1e-14).select("bundle_id", F.col("ord").cast("string").alias("element"), F.lit("bad area").alias("fault")))
    edges = joined_edges(t)
    if not whole_groups(edges):
        edges = cut(edges)
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    vertical = F.col("a.floorId") != F.col("z.floorId")
    shaped = F.coalesce((F.size("path") >= 2) & F.forall("path", _real_point), F.lit(False))
    length = g.polyline_length(F.col("path")) * F.when(F.col("distanceUnit") == "meter", F.col("meters_per_unit")).otherwise(1.0)
    distance = F.col("distance")
    # The rules of edges between two supported nodes.
    live = [
        ("bad distance", ~F.coalesce(g.is_finite(distance) & (distance >= 0), F.lit(False))),
        ("bad unit", ~F.coalesce(F.col("distanceUnit").isin(*UNITS), F.lit(False))),
        ("unconfirmed metres", (F.col("distanceUnit") == "meter") & ~F.col("metric")),
        ("bad geometry", ~shaped),
        ("loose geometry", shaped & ~(_near(first, F.col("a.xy")) & _near(last, F.col("z.xy")))),
        ("floor change without stairs", vertical & ~F.col("pathType").isin(*VERTICAL)),
        (
            "wrong floor",
            ~F.coalesce((F.col("floorId") == F.col("a.floorId")) | (vertical & (F.col("floorId") == F.col("z.floorId"))), F.lit(False)),
        ),
        ("two buildings", F.col("a.buildingId") != F.col("z.buildingId")),
        (
            "false length",
            drawing & ~vertical & shaped & ((length <= 0) | (F.abs(distance - length) > F.greatest(F.lit(0.01), length * 1e-5))),
        ),
    ]
    lost = ("missing endpoint", F.col("a").isNull() | F.col("z").isNull())
    parts.append(faults(considered(edges), F.col("id"), lost, *[(name, _supported_ends() & rule) for name, rule in live]))
    if geometry:
        parts.append(
            unsafe_edges(usable(edges), t).select("bundle_id", F.col("edge_id").alias("element"), F.concat(F.lit("unsafe: "), "fault").alias("fault"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def steps_of(t: dict[str, DataFrame]) -> DataFrame:
    """Directed steps of all graphs with cost in the graph's unit, oriented geometry and end facts."""
    edges = usable(joined_edges(t))
    cost = F.when((F.col("distanceUnit") == "map-unit") & F.col("metric"), F.col("distance") * F.col("meters_per_unit")).otherwise(F.col("distance"))

    def step(a: str, z: str, path: Column) -> Column:
        return F.struct(
            F.col(f"{a}.id").alias("src"),
            F.col(f"{z}.id").alias("dst"),
            F.col(f"{a}.floorId").alias("from_floor"),
            F.col(f"{z}.floorId").alias("to_floor"),
            F.col(f"{a}.type").alias("from_type"),
            F.col(f"{z}.type").alias("to_type"),
            F.col(f"{z}.roomId").alias("to_room"),
            path.alias("path"),
        )

    forward, back = step("a", "z", F.col("path")), step("z", "a", F.reverse("path"))
    ways = F.when(F.col("bidirectional"), F.array(forward, back)).otherwise(F.array(forward))
    spread = edges.select(
        "bundle_id",
        F.col("id").alias("edge_id"),
        F.col("pathType").alias("path_type"),
        ((F.col("accessibility") == "confirmed") & (F.col("pathType") != "stairs")).alias("step_free"),
        cost.alias("cost"),
        F.explode(ways).alias("w"),
    )
    return spread.select("bundle_id", "edge_id", "path_type", "step_free", "cost", "w.*")


def verdict(status: str, reason: str | None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))


def _judged(requests: DataFrame, t: dict[str, DataFrame], geometry: bool) -> DataFrame:
    """Requests with their graph's facts and, where no search can change it, the verdict ``early``."""
    requests = cut(requests.withColumn("accessible", F.coalesce("accessible", F.lit(False))))
    broken = cut(graph_violations(t, geometry).select("bundle_id").distinct())
    facts = graph_facts(t["graphs"])
    nodes = t["nodes"].join(held(facts.select("bundle_id", "policy")), "bundle_id").select(
        "bundle_id", "id", "xy", nw.evidence_ok("status", F.col("policy")).alias("ok")
    )
    asked_nodes = requests.select("bundle_id", F.explode(F.array("start_node", "end_node")).alias("id")).distinct()
    asked_nodes = cut(nodes.join(held(asked_nodes), ["bundle_id", "id"], "left_semi").dropDuplicates(["bundle_id", "id"]))
    unsafe = unsafe_nodes(asked_nodes, t) if geometry else None
    marked = asked_nodes.select("bundle_id", "id", "ok")
    if unsafe is not None:
        marked = marked.join(
            held(unsafe.select("bundle_id", F.col("node_id").alias("id"), F.lit(True).alias("unsafe"))), ["bundle_id", "id"], "left"
        )
    else:
        marked = marked.withColumn("unsafe", F.lit(None).cast("boolean"))
    end = F.struct("ok", F.coalesce("unsafe", F.lit(False)).alias("unsafe"))
    marked = cut(marked.select("bundle_id", "id", end.alias("n")))
    judged = (
        requests.join(held(facts), "bundle_id", "left")
        .join(held(broken.withColumn("broken", F.lit(True))), "bundle_id", "left")
        .join(held(marked.select("bundle_id", F.col("id").alias("start_node"), F.col("n").alias("s"))), ["bundle_id", "start_node"], "left")
        .join(held(marked.select("bundle_id", F.col("id").alias("end_node"), F.col("n").alias("e"))), ["bundle_id", "end_node"], "left")
    )
    confirmed = F.col("graph_status") == "confirmed"
    early = (
        F.when(F.col("start_node").isNull(), verdict("unavailable", "start"))
        .when(F.col("end_node").isNull(), verdict("unavailable", "destination"))
        .when(F.col("broken"), verdict("invalid", "invalid"))
        .when((F.col("s").isNull() | F.col("e").isNull()) & confirmed, verdict("invalid", "missing"))
        .when(F.col("s").isNull() | F.col("e").isNull(), verdict("unconfirmed", "unconfirmed"))
        .when(~F.col("s.ok") | ~F.col("e.ok"), verdict("unconfirmed", "unconfirmed"))
        .when(F.col("s.unsafe") | F.col("e.unsafe"), verdict("invalid", "invalid"))
    )
    kept = judged.drop("s", "e", "broken", "calibration_status")
    return cut(judged.withColumn("early", early).select(*kept.columns, "early"))


def route_requests(requests: DataFrame, t: dict[str, DataFrame], geometry: bool = True) -> tuple[DataFrame, DataFrame]:
    """Outcome per request and the ordered steps of the routes found.

    requests: route_id, bundle_id, start_node, end_node, accessible.  Returns
    (route_id, status, reason, reason_en, reason_ar, distance, unit) and the step table of ``instructions``.
    """
    t = _prepared(dict(t))
    judged = _judged(requests, t, geometry)
    open_ = judged.filter("early is null")
    scope = ["bundle_id", "accessible"]
    # Only graphs with an open request are searched, none of which is broken, and only in the modes that are asked for.
    asked = open_.select(*scope).distinct()
    graphs = held(asked.select("bundle_id").distinct())
    steps = steps_of({**t, **{name: t[name].join(graphs, "bundle_id", "left_semi") for name in ("nodes", "edges")}})
    if not whole_groups(steps):
        steps = cut(steps)
    modes = steps.join(held(asked), "bundle_id").filter("step_free or not accessible")
    sources = open_.select(*scope, F.col("start_node").alias("source")).distinct()
    tree = cut(nw.shortest_tree(modes.select(*scope, "src", "dst", "cost", "edge_id"), sources, scope))
    reach = tree.select(*scope, F.col("source").alias("start_node"), F.col("node").alias("end_node"), F.col("cost").alias("distance"))
    timed = judged.join(held(reach), [*scope, "start_node", "end_node"], "left")
    confirmed = F.col("graph_status") == "confirmed"
    drawing = F.coalesce(F.col("policy"), F.lit(nw.VERIFIED)) == nw.DRAWING
    lost = (
        F.when(~drawing & ~confirmed & ~F.col("accessible"), verdict("unconfirmed", "unconfirmed"))
        .when(F.col("accessible"), verdict("unavailable", "accessible"))
        .otherwise(verdict("unavailable", "disconnected"))
    )
    found = F.col("early").isNull() & F.col("distance").isNotNull()
    ok = verdict("ok", None)
    outcome = F.coalesce(F.col("early"), F.when(found, ok).otherwise(lost))
    result = timed.withColumn("o", outcome).select(
        "route_id",
        *scope,
        "start_node",
        "end_node",
        F.col("o.status").alias("status"),
        F.col("o.reason").alias("reason"),
        F.when(found, F.col("distance")).otherwise(F.lit(0.0)).alias("distance"),
        F.when(F.coalesce("metric", F.lit(False)), "meter").otherwise("map-unit").alias("unit"),
    )
    result = with_reasons(cut(result))
    # Nothing below reads the requests again, so their checkpoint may go.
    del judged, open_, sources, reach, timed, asked, modes
    wanted = result.filter("status = 'ok'").select("route_id", *scope, F.col("start_node").alias("source"), F.col("end_node").alias("target"))
    walked = nw.path_steps(tree, wanted, scope)
    details = steps.drop("step_free").withColumnRenamed("src", "from_node").withColumnRenamed("dst", "to_node")
    path = held(walked.select("route_id", "ord", "bundle_id", "from_node", "to_node", "edge_id")).join(
        details, ["bundle_id", "edge_id", "from_node", "to_node"]
    )
    return result, path


def with_reasons(results: DataFrame) -> DataFrame:
    def text(i: int) -> Column:
        out = F.lit(None).cast("string")
        for key, words in REASONS.items():
            out = F.when(F.col("reason") == key, words[i]).otherwise(out)
        return out

    return results.withColumns({"reason_en": text(0), "reason_ar": text(1)})


def route_points(path: DataFrame, eps: float = TOL.eps, scope: Sequence[str] = ()) -> DataFrame:
    """Drawn points of each route in order, without points repeating the one before; ``scope`` names columns that go with it."""
    from concourse.operators.ordered import ordinal_chunk
    from concourse.operators.sequences import join_polylines

    points = path.select(*scope, "route_id", "ord", F.posexplode("path").alias("sub", "p"))
    points = points.select(*scope, "route_id", "ord", "sub", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return join_polylines(points, "route_id", ["ord", "sub"], ordinal_chunk("ord"), eps, scope)


def valid_paths(sequences: DataFrame, steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Supplied paths that are contiguous and eligible: path_id, nodes ARRAY, edges ARRAY -> path_id.

    steps: src, dst, edge_id; starts: the usable node_ids, which a path must begin at.
    """
    shaped = sequences.filter((F.size("nodes") > 0) & (F.size("nodes") == F.size("edges") + 1))
    shaped = shaped.join(starts.select("node_id"), F.get("nodes", F.lit(0)) == F.col("node_id"), "left_semi")
    hops = F.transform(
        "edges",
        lambda e, i: F.struct(F.get("nodes", i).alias("src"), e.alias("edge_id"), F.get("nodes", i + 1).alias("dst")),
    )
    asked = shaped.select("path_id", F.size("edges").alias("n"), F.posexplode_outer(hops).alias("pos", "h"))
    asked = asked.select("path_id", "n", "pos", "h.*")
    known = steps.select("src", "edge_id", "dst").distinct().withColumn("hit", F.lit(1))
    hits = asked.join(known, ["src", "edge_id", "dst"], "left")
    return hits.groupBy("path_id", "n").agg(F.count("hit").alias("found")).filter("found = n").select("path_id")
