"""Declarative contract over bundle tables; every violation is a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.operators.spatial import bbox_join


#: Rings of more sides than this have them compared as rows; the contacts found are the same.
SIDES_IN_ROW = 64


def ring_faults(
    rings: DataFrame, eps: float, min_area: float, tol: g.Tolerance | None = None, key: Sequence[str] = ("bundle_id", "ord")
) -> DataFrame:
    """Rows whose ``ring`` is no simple area: too few points, unreal numbers, no area, a zero side or a self-contact.

    ``key`` names a ring, whose columns are of plain types; rings under one name are told apart by a hash of their points.
    """
    tol = tol or g.Tolerance(eps)
    ring = g.clean_ring(F.col("ring"), eps)
    real = F.coalesce(F.forall("ring", lambda p: g.is_finite(p["x"]) & g.is_finite(p["y"])), F.lit(False))
    n = F.size(ring)
    sides = g.ring_sides(ring)
    short = F.exists(sides, lambda s: g.dist(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) < eps)
    flat = ~F.coalesce(F.abs(g.ring_area(ring)) * 2 >= min_area, F.lit(False))
    indexed = F.transform(sides, lambda s, i: F.struct(i.alias("i"), s["a"].alias("a"), s["b"].alias("b")))

    def faults(tangled: Column) -> Column:
        return (
            F.when(~real, "not finite")
            .when(n < 3, "too few points")
            .when(flat, "no area")
            .when(short, "zero side")
            .when(tangled, "self-intersection")
        )

    wide = F.coalesce(real & (n > SIDES_IN_ROW), F.lit(False))
    plain = _judged(rings.filter(~wide), ring, eps, min_area, tol)
    many = rings.filter(wide).withColumn("_ring", F.to_json(F.struct(*key, F.xxhash64("ring").alias("_points"))))
    knots = _knots(many.select("_ring", indexed.alias("_sides")), tol).withColumn("_tangled", F.lit(True))
    many = many.join(knots, "_ring", "left").withColumn("ring_fault", faults(F.col("_tangled"))).drop("_ring", "_tangled")
    return plain.unionByName(many).filter("ring_fault is not null")


def _judged(rings: DataFrame, ring: Column, eps: float, min_area: float, tol: g.Tolerance) -> DataFrame:
    """The faults of rings whose sides are compared within their row.

    The cleaned ring and its sides are columns of their own, made once a ring and not once a side; a filter on the fault
    would be pushed down through them and make them again, so outer rows are dropped instead.
    """
    real = F.coalesce(F.forall("ring", lambda p: g.is_finite(p["x"]) & g.is_finite(p["y"])), F.lit(False))
    n = F.size("_clean")
    made = rings.withColumn("_clean", ring)
    made = made.withColumn("_sides", F.transform(g.ring_sides(F.col("_clean")), lambda s, i: F.struct(i.alias("i"), s["a"].alias("a"), s["b"].alias("b"))))

    def crossing(s: Column) -> Column:
        later = F.slice("_sides", s["i"] + 3, F.greatest(n - s["i"] - 2, F.lit(0)))
        return F.exists(
            later,
            lambda o: ~((s["i"] == 0) & (o["i"] == n - 1))
            & g.segments_touch(
                s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], o["a"]["x"], o["a"]["y"], o["b"]["x"], o["b"]["y"], tol
            ),
        )

    fault = (
        F.when(~real, "not finite")
        .when(n < 3, "too few points")
        .when(~F.coalesce(F.abs(g.ring_area(F.col("_clean"))) * 2 >= min_area, F.lit(False)), "no area")
        .when(F.exists("_sides", lambda s: g.dist(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) < eps), "zero side")
        .when(F.exists("_sides", crossing), "self-intersection")
    )
    return made.withColumn("ring_fault", F.explode_outer(F.array(fault))).drop("_clean", "_sides")


def _knots(rings: DataFrame, tol: g.Tolerance) -> DataFrame:
    """Names (``_ring``) of the rings two of whose sides touch that are no neighbours; a side meets those in its cells only."""
    n = F.size("_sides")
    ends = [F.col("_sides.a")[c] for c in "xy"]
    # Cells are about as wide as a side is long where a ring runs round its box.
    unit = F.greatest(*[F.array_max(e) - F.array_min(e) for e in ends], F.lit(1e-300)) / n
    # Figures of a ring are made before its sides are spread, once a ring and not once a side.
    rows = rings.withColumns({"_n": n, "_unit": unit}).select("_ring", "_n", "_unit", F.explode("_sides").alias("s"))

    def renamed(prefix: str, *more: str) -> DataFrame:
        parts = {"i": "s.i", "ax": "s.a.x", "ay": "s.a.y", "bx": "s.b.x", "by": "s.b.y", "unit": "_unit"}
        return rows.select("_ring", *more, *[F.col(path).cast("double" if name != "i" else "int").alias(prefix + name) for name, path in parts.items()])

    def span(p: str) -> list[Column]:
        c = lambda name: F.col(p + name)
        low = [F.least(c("ax"), c("bx")) - tol.eps, F.least(c("ay"), c("by")) - tol.eps]
        high = [F.greatest(c("ax"), c("bx")) + tol.eps, F.greatest(c("ay"), c("by")) + tol.eps]
        return [v / c("unit") for v in low + high]

    pairs = bbox_join(renamed("p_", "_n"), renamed("q_"), span("p_"), span("q_"), on=["_ring"])
    apart = (F.col("q_i") >= F.col("p_i") + 2) & ~((F.col("p_i") == 0) & (F.col("q_i") == F.col("_n") - 1))
    touch = g.segments_touch(*[F.col(p + c) for p in ("p_", "q_") for c in ("ax", "ay", "bx", "by")], tol)
    return pairs.filter(apart).filter(touch).select("_ring").distinct()


# Domains, limits and formats of the contract.
STATUSES = ("confirmed", "candidate", "unknown")
CATEGORIES = ("classroom", "office", "laboratory", "service", "restroom", "circulation", "other")
NODE_TYPES = ("junction", "door", "entrance", "elevator", "stairs", "kiosk")
PATH_TYPES = ("corridor", "door", "entrance", "stairs", "elevator")
FEATURE_KINDS = ("escalator", "elevator")
POLICIES = ("verified-only", "drawing-based")
AVAILABILITY = ("available", "unavailable")
ACCESS = ("confirmed", "inaccessible", "unknown")
RESTRICTIONS = ("open", "closed", "unknown")
UNITS = ("map-unit", "meter")
VERTICAL = ("stairs", "elevator")
SAFE_ID = "^[A-Za-z0-9_-]+$"
BOUNDS_SLACK, MIN_TWICE_AREA = 1e-3, 1e-7
LENGTH_SLACK, LENGTH_RATIO = 0.01, 1e-5
ANCHOR_LIMIT = 0.02
TOL = g.CONTRACT


def filled(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def localized(c: Column) -> Column:
    return filled(c["en"]) & filled(c["ar"])


def one_of(c: Column, domain) -> Column:
    return c.isin(list(domain))


def null_or(c: Column, ok: Column) -> Column:
    return c.isNull() | ok


def real(p: Column) -> Column:
    return g.is_finite(p["x"]) & g.is_finite(p["y"])


def scale_ok() -> Column:
    scale, status = F.col("meters_per_unit"), F.col("calibration_status")
    positive = null_or(scale, g.is_finite(scale) & (scale > 0))
    return one_of(status, STATUSES) & positive & ((status == "confirmed") == scale.isNotNull())


def evidence_ok(c: Column, whole_page: bool = True) -> Column:
    def entry(e: Column) -> Column:
        page = g.is_finite(e["page"])
        if whole_page:
            page = page & (e["page"] >= 1) & (e["page"] == F.floor(e["page"]))
        return filled(e["source"]) & filled(e["note"]) & one_of(e["status"], STATUSES) & page

    return (F.size(c) > 0) & F.forall(c, lambda e: F.coalesce(entry(e), F.lit(False)))


def in_view(p: Column) -> Column:
    box = F.col("view_box")
    x0, y0, w, h = (F.get(box, F.lit(i)) for i in range(4))
    s = BOUNDS_SLACK
    return (p["x"] >= x0 - s) & (p["y"] >= y0 - s) & (p["x"] <= x0 + w + s) & (p["y"] <= y0 + h + s)


def ring_in_view(ring: str) -> Column:
    """All vertices inside the view box; tested on the box corners of the ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    low = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"))
    high = F.struct(F.array_max(xs).alias("x"), F.array_max(ys).alias("y"))
    return in_view(low) & in_view(high)


def rows(df: DataFrame, entity: str, path: Column, *rules: tuple[str, Column, str]) -> DataFrame:
    """Violations of row rules: each rule is (id, what must hold, message); an unknown answer violates it."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(message).alias("message")))
                for rule, ok, message in rules
            ]
        )
    )
    return df.select("bundle_id", F.lit(entity).alias("entity"), path.cast("string").alias("path"), F.explode(broken).alias("r")).select(
        "r.rule_id", "bundle_id", "entity", "path", "r.message"
    )


def listed(df: DataFrame, rule: str, entity: str, path: Column, message: str) -> DataFrame:
    """Every row of ``df`` is a violation."""
    return df.select(
        F.lit(rule).alias("rule_id"), "bundle_id", F.lit(entity).alias("entity"), path.cast("string").alias("path"), F.lit(message).alias("message")
    )


class Contract:
    """Rules over one set of bundle tables; each method gives the violations of related rules."""

    def __init__(self, t: dict[str, DataFrame]):
        self.t = t
        f = t["floors"]
        self.scope = f.select(
            "bundle_id", F.col("building_id").alias("b_id"), F.col("floor_id").alias("f_id"), "floor_ids", "view_box"
        )
        self.graph = t["graphs"].select(
            "bundle_id",
            (F.coalesce("policy", F.lit("")) == "drawing-based").alias("drawing"),
            F.col("meters_per_unit").alias("g_scale"),
            F.col("calibration_status").alias("g_calibration"),
            F.col("status").alias("g_status"),
            F.coalesce("n_areas", F.lit(0)).alias("g_areas"),
            F.coalesce("n_walls", F.lit(0)).alias("g_walls"),
        )

    def _scoped(self, name: str) -> DataFrame:
        return self.t[name].join(self.scope, "bundle_id", "left")

    def floors(self) -> DataFrame:
        f = self.t["floors"]
        asset, box = F.col("map_asset"), F.col("view_box")
        safe = (
            F.startswith(asset, F.lit("/maps/"))
            & ~F.contains(asset, F.lit(".."))
            & ~asset.rlike(r"[\\?#]")
            & (asset == F.concat(F.lit("/maps/"), "building_id", F.lit("/"), "floor_id", F.lit("/master.svg")))
        )
        ids = F.col("floor_ids")
        boxed = (F.size(box) == 4) & F.forall(box, g.is_finite) & (F.get(box, F.lit(2)) > 0) & (F.get(box, F.lit(3)) > 0)
        return rows(
            f,
            "floor",
            F.col("floor_id"),
            ("R01", F.col("schema_version") == 1, "schema version must be 1"),
            ("R02", F.col("building_id").rlike(SAFE_ID) & F.col("floor_id").rlike(SAFE_ID), "ids must be safe path segments"),
            ("R03", localized(F.col("building_name")) & localized(F.col("name")), "names need both languages"),
            (
                "R04",
                F.forall(ids, filled)
                & (F.size(F.array_distinct(ids)) == F.size(ids))
                & F.array_contains(ids, F.col("floor_id"))
                & (F.col("floor_building_id") == F.col("building_id")),
                "floor and building must belong together",
            ),
            ("R05", safe, "asset must be the floor's own local drawing"),
            ("R06", boxed & g.is_finite(F.col("level")), "view box needs four numbers and a positive size"),
            ("R07", scale_ok(), "scale must be present exactly when confirmed"),
        )

    def defaults(self) -> DataFrame:
        asked = self.t["floors"].filter("has_defaults")
        rooms = self.t["places"].select("bundle_id", F.col("id").alias("start_room_id"))
        return listed(
            asked.join(rooms, ["bundle_id", "start_room_id"], "left_anti"), "R11", "floor", F.col("start_room_id"), "default start must exist"
        )

    def graphs(self) -> DataFrame:
        own = self.t["floors"].select(
            "bundle_id", F.col("meters_per_unit").alias("f_scale"), F.col("calibration_status").alias("f_calibration")
        )
        agree = F.col("meters_per_unit").eqNullSafe(F.col("f_scale")) & F.col("calibration_status").eqNullSafe(F.col("f_calibration"))
        drawing = F.coalesce("policy", F.lit("")) == "drawing-based"
        policy = null_or(F.col("policy"), one_of(F.col("policy"), POLICIES)) & one_of(F.col("status"), STATUSES)
        return rows(
            self.t["graphs"].join(own, "bundle_id", "left"),
            "graph",
            F.lit("graph"),
            ("R07", scale_ok(), "scale must be present exactly when confirmed"),
            ("R21", policy & (~drawing | (F.coalesce("n_areas", F.lit(0)) > 0)), "policy must be known and have its areas"),
            ("R22", agree, "floor and graph calibration must agree"),
        )

    def identities(self) -> DataFrame:
        parts = []
        for name in ("places", "kiosks", "features", "nodes", "edges", "content"):
            table = self.t[name]
            entity = name.rstrip("s") if name != "content" else name
            parts.append(rows(table, entity, F.col("ord"), ("R09", filled(F.col("id")), "id must be present")))
            keys = ["id"] + (["code"] if name == "places" else [])
            for key in keys:
                copies = table.groupBy("bundle_id", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                parts.append(listed(copies, "R09", entity, F.col(key), f"{key} must be unique"))
        parts.append(rows(self.t["places"], "place", F.col("id"), ("R09", filled(F.col("code")), "code must be present")))
        return _union(parts)

    def places(self) -> DataFrame:
        p = self._scoped("places")
        outline, anchor = F.col("ring").isNotNull(), F.col("anchor")
        note, off = F.col("navigationNote"), F.col("availability")
        known = outline & (F.col("geometryStatus") != "unknown") & F.col("geometryRef").isNotNull()
        unknown = ~outline & (F.col("geometryStatus") == "unknown") & F.col("geometryRef").isNull()
        ref = lambda c: null_or(F.col(c), filled(F.col(c)))
        ring = g.clean_ring(F.col("ring"), TOL.eps)
        return rows(
            p,
            "place",
            F.col("id"),
            ("R08", in_view(anchor) & (~outline | ring_in_view("ring")), "points must lie in the view box"),
            (
                "R12",
                (F.col("buildingId") == F.col("b_id"))
                & (F.col("floorId") == F.col("f_id"))
                & localized(F.col("name"))
                & one_of(F.col("category"), CATEGORIES)
                & one_of(F.col("geometryStatus"), STATUSES)
                & real(anchor)
                & ref("geometryRef")
                & ref("doorNodeId"),
                "place scope and domains",
            ),
            ("R13", null_or(note, localized(note)) & (~F.coalesce("navigationPartial", F.lit(False)) | note.isNotNull()), "partial routes need a note"),
            (
                "R14",
                null_or(
                    off,
                    F.coalesce(
                        one_of(off["status"], AVAILABILITY)
                        & localized(off["reason"])
                        & null_or(off["configurationId"], filled(off["configurationId"]))
                        & off["roomId"].isNull(),
                        F.lit(False),
                    ),
                ),
                "availability needs a status and a bilingual reason of its own",
            ),
            ("R16", ~outline | g.ring_contains(ring, anchor["x"], anchor["y"], TOL), "label must lie in its outline"),
            ("R17", known | unknown, "outline, reference and evidence must agree"),
            ("R18", F.forall("aliases", filled) & F.col("public").isNotNull(), "aliases must be filled and visibility stated"),
            ("R20", evidence_ok(F.col("provenance")), "source evidence is required"),
        )

    def rings(self) -> DataFrame:
        outlined = self.t["places"].filter("ring is not null").select("bundle_id", F.lit("place").alias("entity"), F.col("id").alias("path"), "ring")
        features = self.t["features"].select("bundle_id", F.lit("feature").alias("entity"), F.col("id").alias("path"), "ring")
        bad = ring_faults(outlined.unionByName(features), TOL.eps, MIN_TWICE_AREA, TOL, ("bundle_id", "entity", "path"))
        own = bad.select(F.when(F.col("entity") == "place", "R15").otherwise("R10").alias("rule_id"), "bundle_id", "entity", "path", F.col("ring_fault").alias("message"))
        areas = ring_faults(self.t["areas"], TOL.eps, MIN_TWICE_AREA, TOL)
        areas = areas.select(F.lit("R23").alias("rule_id"), "bundle_id", F.lit("area").alias("entity"), F.col("ord").cast("string").alias("path"), F.col("ring_fault").alias("message"))
        view = rows(self._scoped("areas"), "area", F.col("ord"), ("R23", ring_in_view("ring"), "area must lie in the view box"))
        walls = rows(self.t["walls"], "wall", F.col("ord"), ("R23", (F.size("path") == 2) & F.forall("path", real), "wall needs two points"))
        return _union([own, areas, view, walls])

    def content(self) -> DataFrame:
        c, p = self.t["content"], self.t["places"]
        ids = c.select("bundle_id", F.col("id").alias("contentRef"))
        lost = p.join(ids, ["bundle_id", "contentRef"], "left_anti")
        used = p.select("bundle_id", F.col("contentRef").alias("id"))
        spare = c.join(used, ["bundle_id", "id"], "left_anti")
        fields = rows(
            c,
            "content",
            F.col("id"),
            (
                "R19",
                localized(F.col("description")) & localized(F.col("imageAlt")) & F.col("placeholder").isNotNull()
                & null_or(F.col("image"), filled(F.col("image"))),
                "content fields",
            ),
        )
        return _union(
            [listed(lost, "R19", "place", F.col("id"), "content must exist"), listed(spare, "R19", "content", F.col("id"), "content is unused"), fields]
        )

    def features(self) -> DataFrame:
        f = self._scoped("features")
        ok = (
            (F.col("buildingId") == F.col("b_id"))
            & (F.col("floorId") == F.col("f_id"))
            & localized(F.col("name"))
            & one_of(F.col("kind"), FEATURE_KINDS)
            & one_of(F.col("geometryStatus"), STATUSES)
            & one_of(F.col("accessibility"), STATUSES)
            & ring_in_view("ring")
            & F.forall("connectedFloorIds", lambda v: F.coalesce(F.array_contains(F.col("floor_ids"), v), F.lit(False)))
            & evidence_ok(F.col("provenance"), whole_page=False)
        )
        return rows(f, "feature", F.col("id"), ("R10", ok, "feature scope, kind, floors and evidence"))

    def _rooms(self) -> DataFrame:
        room = F.struct(F.col("id").alias("id"), "floorId", "geometryStatus", "ring", "doorNodeId")
        return self.t["places"].select("bundle_id", F.col("id").alias("room_key"), room.alias("room")).dropDuplicates(["bundle_id", "room_key"])

    def nodes(self) -> DataFrame:
        n = self._scoped("nodes")
        rooms = self._rooms().select("bundle_id", F.col("room_key").alias("roomId"), F.lit(True).alias("room_found"))
        n = n.join(rooms, ["bundle_id", "roomId"], "left")
        ok = (
            real(F.col("xy"))
            & one_of(F.col("type"), NODE_TYPES)
            & one_of(F.col("status"), STATUSES)
            & (F.col("buildingId") == F.col("b_id"))
            & F.array_contains("floor_ids", F.col("floorId"))
            & ((F.col("floorId") != F.col("f_id")) | in_view(F.col("xy")))
            & (F.col("roomId").isNull() | F.coalesce("room_found", F.lit(False)))
            & ((F.col("type") != "door") | F.col("roomId").isNotNull())
        )
        return rows(n, "node", F.col("id"), ("R24", ok, "node scope, position and room"))

    def _ends(self) -> DataFrame:
        end = F.struct("floorId", "xy", "type", "roomId", "status")
        return self.t["nodes"].select("bundle_id", F.col("id").alias("n_id"), end.alias("n")).dropDuplicates(["bundle_id", "n_id"])

    def doors(self) -> DataFrame:
        """Door reciprocity (R25) and confirmed doors on their room's outline (R26)."""
        ends = self._ends().select("bundle_id", F.col("n_id").alias("doorNodeId"), "n")
        linked = self.t["places"].filter("doorNodeId is not null").join(self.graph, "bundle_id", "left").join(ends, ["bundle_id", "doorNodeId"], "left")
        kinds = F.when(F.col("drawing"), F.col("n.type").isin("door", "entrance", "junction")).otherwise(F.col("n.type") == "door")
        mutual = kinds & (F.col("n.roomId") == F.col("id")) & (F.col("n.floorId") == F.col("floorId"))
        x, y = F.col("n.xy.x"), F.col("n.xy.y")
        touching = F.exists(
            g.ring_sides(F.col("ring")), lambda s: g.on_segment(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], TOL)
        )
        placed = (F.col("n.status") != "confirmed") | ((F.col("geometryStatus") == "confirmed") & touching)
        return rows(
            linked,
            "place",
            F.col("id"),
            ("R25", mutual, "door node must point back to its place"),
            ("R26", F.col("n").isNull() | placed, "confirmed door must lie on a confirmed outline"),
        )

    def kiosks(self) -> DataFrame:
        ends = self._ends().select("bundle_id", F.col("n_id").alias("nodeId"), "n")
        k = self._scoped("kiosks").join(ends, ["bundle_id", "nodeId"], "left")
        node_ok = (F.col("n.floorId") == F.col("f_id")) & ((F.col("status") != "confirmed") | (F.col("n.status") == "confirmed"))
        ok = (
            localized(F.col("name"))
            & one_of(F.col("status"), STATUSES)
            & (F.col("buildingId") == F.col("b_id"))
            & (F.col("floorId") == F.col("f_id"))
            & F.when(F.col("nodeId").isNull(), F.col("status") != "confirmed").otherwise(node_ok)
        )
        return rows(k, "kiosk", F.col("id"), ("R27", ok, "kiosk scope and node"))

    def _edges(self) -> DataFrame:
        ends = self._ends()
        a = ends.select("bundle_id", F.col("n_id").alias("from"), F.col("n").alias("a"))
        z = ends.select("bundle_id", F.col("n_id").alias("to"), F.col("n").alias("z"))
        e = self._scoped("edges").join(self.graph, "bundle_id", "left")
        return e.join(a, ["bundle_id", "from"], "left").join(z, ["bundle_id", "to"], "left")

    def _routable(self) -> Column:
        return (F.col("status") == "confirmed") | (F.col("drawing") & (F.col("status") == "candidate"))

    def edges(self) -> DataFrame:
        e = self._edges()
        both = F.col("a").isNotNull() & F.col("z").isNotNull()
        level = F.col("a.floorId") == F.col("z.floorId")
        first, last = F.element_at("path", 1), F.element_at("path", -1)
        near = lambda p, q: g.dist(p["x"], p["y"], q["x"], q["y"]) < TOL.eps
        joined = (F.size("path") >= 2) & F.forall("path", real) & near(first, F.col("a.xy")) & near(last, F.col("z.xy"))
        length = g.polyline_length(F.col("path"))
        metric = F.col("distanceUnit") == "meter"
        expected = length * F.when(metric, F.col("g_scale")).otherwise(F.lit(1.0))
        distance = F.col("distance")
        close = F.abs(distance - expected) <= F.greatest(F.lit(LENGTH_SLACK), expected * LENGTH_RATIO)
        routable, drawing = self._routable(), F.col("drawing")
        backed = ((F.col("status") != "confirmed") | ((F.col("a.status") == "confirmed") & (F.col("z.status") == "confirmed"))) & (
            ~drawing | ((F.col("a.status") != "unknown") & (F.col("z.status") != "unknown"))
        )
        fenced = F.when(level, F.col("g_areas") > 0).otherwise((F.col("g_areas") == 0) & (F.col("g_walls") == 0))
        domains = (
            one_of(F.col("pathType"), PATH_TYPES)
            & one_of(F.col("distanceUnit"), UNITS)
            & one_of(F.col("accessibility"), ACCESS)
            & one_of(F.col("restriction"), RESTRICTIONS)
            & one_of(F.col("status"), STATUSES)
            & F.col("bidirectional").isNotNull()
        )
        return rows(
            e,
            "edge",
            F.col("id"),
            ("R28", both & (F.col("from") != F.col("to")) & domains, "edge needs two distinct nodes and known domains"),
            (
                "R29",
                ~both
                | ((F.col("floorId") == F.col("a.floorId")) & F.array_contains("floor_ids", F.col("floorId")) & (level | F.col("pathType").isin(*VERTICAL))),
                "edge floor and floor change",
            ),
            ("R30", ~both | joined, "geometry must join its nodes"),
            (
                "R31",
                ~both | (g.is_finite(distance) & (distance > 0) & g.is_finite(length) & (length > 0) & (~level | F.coalesce(close, metric & F.col("g_scale").isNull()))),
                "length must be positive and agree with the geometry",
            ),
            ("R32", ~metric | (F.col("g_calibration") == "confirmed"), "metres need a confirmed scale"),
            ("R33", ~both | ~routable | backed, "edge evidence exceeds its nodes"),
            ("R34", ~both | ~routable | fenced, "constraints do not fit the edge"),
        )

    def safety(self, base: float = 1.0) -> DataFrame:
        """Routable edges that touch a wall or leave the areas (R35)."""
        from concourse.operators.routing import unsafe_edges

        bad = unsafe_edges(self._edges().filter(self._routable()), self.t, TOL, base)
        return bad.select(
            F.lit("R35").alias("rule_id"), "bundle_id", F.lit("edge").alias("entity"), F.col("edge_id").alias("path"), F.col("fault").alias("message")
        )

    def gate(self) -> DataFrame:
        parts = [self.t[n].select("bundle_id", F.lit(n.rstrip("s")).alias("entity"), F.col("id").alias("path"), "status") for n in ("nodes", "edges")]
        sealed = self.graph.filter("g_status = 'confirmed'").select("bundle_id")
        weak = _union(parts).filter(~F.coalesce(F.col("status") == "confirmed", F.lit(False))).join(sealed, "bundle_id", "left_semi")
        return weak.select(F.lit("R36").alias("rule_id"), "bundle_id", "entity", "path", F.lit("confirmed graph holds unconfirmed elements").alias("message"))

    def registry(self) -> DataFrame:
        """Catalogue across bundles (R37): unique floors and kiosks, one building record, no floor left out."""
        f = self.t["floors"]
        whole = lambda df, path, message: df.select(
            F.lit("R37").alias("rule_id"), F.lit(None).cast("string").alias("bundle_id"), F.lit("registry").alias("entity"), path.alias("path"), F.lit(message).alias("message")
        )
        twice = f.groupBy("building_id", "floor_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        kiosks = self.t["kiosks"].groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        version = F.struct("building_name", F.array_sort("floor_ids"))
        unlike = f.groupBy("building_id").agg(F.count_distinct(version).alias("n")).filter("n > 1")
        declared = f.select("building_id", F.explode("floor_ids").alias("floor_id")).distinct()
        missing = declared.join(f.select("building_id", "floor_id"), ["building_id", "floor_id"], "left_anti")
        floor = F.concat_ws("/", "building_id", "floor_id")
        return _union(
            [
                whole(twice, floor, "floor registered twice"),
                whole(kiosks, F.col("id"), "kiosk registered twice"),
                whole(unlike, F.col("building_id"), "building recorded differently"),
                whole(missing, floor, "declared floor is missing"),
            ]
        )

    def mixed_floors(self) -> DataFrame:
        """Constraints over more than one supported floor (R39)."""
        n = self.t["nodes"].join(self.graph.filter("g_areas > 0 or g_walls > 0"), "bundle_id")
        floors = n.filter(self._routable()).groupBy("bundle_id").agg(F.count_distinct("floorId").alias("n")).filter("n > 1")
        return listed(floors, "R39", "graph", F.lit("graph"), "constraints lack floor scope")

    def endpoints(self, base: float = 1.0) -> DataFrame:
        """Places' door nodes on walls or outside the areas (R40)."""
        from concourse.operators.routing import unsafe_nodes

        doors = self.t["places"].select("bundle_id", F.col("doorNodeId").alias("id")).filter("id is not null")
        bad = unsafe_nodes(self.t["nodes"].join(doors, ["bundle_id", "id"], "left_semi"), self.t, base)
        return listed(bad, "R40", "node", F.col("node_id"), "endpoint stands on unsafe ground")

    def inventory(self) -> DataFrame:
        """Nothing unverified is claimed (R43): access unknown, kiosks unplaced, scale absent under the drawing policy."""
        drawing = self.graph.filter("drawing").select("bundle_id")
        e = rows(
            self.t["edges"].join(drawing, "bundle_id", "left_semi"),
            "edge",
            F.col("id"),
            ("R43", (F.col("accessibility") == "unknown") & (F.col("restriction") == "unknown") & (F.col("status") == "candidate"), "access must stay unknown"),
        )
        k = rows(
            self.t["kiosks"].join(drawing, "bundle_id", "left_semi"),
            "kiosk",
            F.col("id"),
            ("R43", F.col("nodeId").isNull() & (F.col("status") == "unknown"), "kiosk must stay unplaced"),
        )
        f = rows(
            self.t["floors"].join(drawing, "bundle_id", "left_semi"), "floor", F.col("floor_id"), ("R43", F.col("meters_per_unit").isNull(), "scale must stay absent")
        )
        return _union([e, k, f])

    def admission(self, base: float = 1.0) -> DataFrame:
        """All rules a bundle must pass to be admitted."""
        return _union(
            [
                self.floors(), self.defaults(), self.graphs(), self.identities(), self.places(), self.rings(), self.content(),
                self.features(), self.nodes(), self.doors(), self.kiosks(), self.edges(), self.safety(base), self.gate(),
            ]
        )


def _union(parts) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate(
    tables: dict[str, DataFrame],
    base: float = 1.0,
    requests: DataFrame | None = None,
    overrides: DataFrame | None = None,
    anchors: DataFrame | None = None,
    inventory: bool = False,
    endpoints: bool = True,
) -> DataFrame:
    """Every violation of the contract, with ``rule_ord`` for the order of checking.

    R01-R37, R39 and R40 read the bundles.  R38, R41 and R42 read tables beside them and are checked where those are
    given: configured kiosks (request_id, kiosk_id, building_id, floor_id), availability overrides (code, status, reason)
    and alignment anchors (anchor_id, residual).  R43 is a policy for unverified inventories, which a sound confirmed
    bundle breaks; ``inventory`` asks for it.  R40 is the router's rule on places' doors; without ``endpoints`` only the rules of
    admission are checked.
    """
    c = Contract(tables)
    parts = [c.admission(base), c.registry(), c.mixed_floors()]
    if endpoints:
        parts.append(c.endpoints(base))

    def beside(faults: DataFrame, rule: str, entity: str, path: str, message: str) -> DataFrame:
        named = faults.select(F.lit(None).cast("string").alias("bundle_id"), F.col(path).cast("string").alias("path"))
        return listed(named, rule, entity, F.col("path"), message)

    if requests is not None:
        parts.append(beside(kiosk_config(requests, tables["kiosks"]), "R38", "request", "request_id", "configured kiosk is not on that floor"))
    if overrides is not None:
        parts.append(beside(override_faults(overrides), "R41", "override", "code", "override has no known status or full reason"))
    if anchors is not None:
        parts.append(beside(anchor_faults(anchors), "R42", "anchor", "anchor_id", "anchor lies beyond the residual limit"))
    if inventory:
        parts.append(c.inventory())
    return _union(parts).withColumn("rule_ord", F.substring("rule_id", 2, 2).cast("int"))


def kiosk_config(requests: DataFrame, kiosks: DataFrame) -> DataFrame:
    """Configured kiosks not registered on the configured floor (R38)."""
    asked = requests.filter("kiosk_id is not null")
    known = kiosks.select(F.col("id").alias("kiosk_id"), F.col("buildingId").alias("building_id"), F.col("floorId").alias("floor_id"))
    return asked.join(known, ["kiosk_id", "building_id", "floor_id"], "left_anti")


def override_faults(overrides: DataFrame) -> DataFrame:
    """Availability overrides with an unknown status or an incomplete reason (R41): code, status, reason."""
    ok = one_of(F.col("status"), AVAILABILITY) & localized(F.col("reason"))
    return overrides.filter(~F.coalesce(ok, F.lit(False)))


def anchor_faults(anchors: DataFrame) -> DataFrame:
    """Alignment anchors beyond the residual limit (R42)."""
    return anchors.filter(F.col("residual") > ANCHOR_LIMIT)
