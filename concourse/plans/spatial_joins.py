"""Spatial joins on points, zones and segments derived from the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.operators import drawings as dw
from concourse.operators import spatial as sp
from concourse.plans import bindings as b
from concourse.plans.registry import query

BASE = 8.0


def side_sql(ox, oy, tx, ty, px, py) -> str:
    return f"(({tx} - {ox}) * ({py} - {oy}) - ({ty} - {oy}) * ({px} - {ox}))"


def on_side_sql(px, py, ax="cx", ay="cy", bx="dx", by="dy") -> str:
    return (
        f"({side_sql(ax, ay, bx, by, px, py)} = 0 AND {px} BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx}) "
        f"AND {py} BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))"
    )


def crosses_sql(px, py, ax="cx", ay="cy", bx="dx", by="dy") -> str:
    lead = f"(({px} - {ax}) * ({by} - {ay}) - ({bx} - {ax}) * ({py} - {ay}))"
    return f"(({ay} > {py}) <> ({by} > {py}) AND CASE WHEN {by} > {ay} THEN {lead} < 0 ELSE {lead} > 0 END)"


def touch_sql(a=("ax", "ay", "bx", "by_"), c=("cx", "cy", "dx", "dy")) -> str:
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, c
    return (
        f"(({side_sql(ax, ay, bx, by, cx, cy)} * {side_sql(ax, ay, bx, by, dx, dy)} < 0 AND "
        f"{side_sql(cx, cy, dx, dy, ax, ay)} * {side_sql(cx, cy, dx, dy, bx, by)} < 0) OR {on_side_sql(ax, ay, cx, cy, dx, dy)} OR "
        f"{on_side_sql(bx, by, cx, cy, dx, dy)} OR {on_side_sql(cx, cy, ax, ay, bx, by)} OR {on_side_sql(dx, dy, ax, ay, bx, by)})"
    )


PIP_SQL = f"""hits AS (SELECT point_id, label, zone_id FROM points, zone_sides GROUP BY ALL
  HAVING bool_or({on_side_sql('x', 'y')}) OR count(*) FILTER (WHERE {crosses_sql('x', 'y')}) % 2 = 1)"""


def _hits(t):
    return sp.points_in_polygons(b.points(t), b.zones(t), ["zone_id"], base=BASE)


@query(
    "join_point_in_polygon",
    b.with_sql(b.ZONES_SQL, PIP_SQL, body="SELECT point_id, zone_id FROM hits"),
)
def point_in_polygon(t):
    return _hits(t).select("point_id", "zone_id")


# Small faces: the bounding boxes of points sharing a rounded position, so that outcomes differ.
FACES_SQL = (
    b.POINTS_SQL
    + """, faces AS (SELECT CAST(floor(x / 100) * 100 + floor(y / 100) AS BIGINT) AS face_id, min(x) - 10 AS min_x, min(y) - 10 AS min_y, max(x) + 10 AS max_x, max(y) + 10 AS max_y
  FROM points GROUP BY floor(x / 100), floor(y / 100))"""
)


def _cell(c):
    return F.floor(F.col(c) / 100)


def box_ring():
    c = {k: F.col(k).cast("double") for k in sp.BOX}
    corners = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y")]
    return F.array(*[g.point(c[x], c[y]) for x, y in corners])


def _faces(t):
    grouped = b.points(t).groupBy((_cell("x") * 100 + _cell("y")).alias("face_id")).agg(
        (F.min("x") - 10).cast("double").alias("min_x"),
        (F.min("y") - 10).cast("double").alias("min_y"),
        (F.max("x") + 10).cast("double").alias("max_x"),
        (F.max("y") + 10).cast("double").alias("max_y"),
    )
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return grouped.withColumn("area", area).withColumn("ring", box_ring())


@query(
    "join_contour_acceptance",
    b.with_sql(
        FACES_SQL,
        """inside AS (SELECT point_id AS label_id, label AS number, face_id, (max_x - min_x) * (max_y - min_y) AS area FROM points JOIN faces
  ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y),
crowd AS (SELECT face_id, count(DISTINCT number) AS numbers FROM inside GROUP BY face_id),
per AS (SELECT label_id, count(*) AS n, min(face_id) AS face_id, max(area) AS area, max(numbers) AS numbers FROM inside JOIN crowd USING (face_id) GROUP BY label_id),
judged AS (SELECT point_id AS label_id, label AS number, face_id, CASE WHEN coalesce(n, 0) <> 1 THEN 'no single face' WHEN area > 12000 THEN 'unbounded face'
  WHEN numbers > 1 THEN 'shared face' WHEN label = 7 THEN 'denied' ELSE 'accepted' END AS outcome FROM points LEFT JOIN per ON label_id = point_id)""",
        body="SELECT label_id, number, outcome, CASE WHEN outcome = 'accepted' THEN face_id END AS face_id FROM judged",
    ),
)
def contour_acceptance(t):
    labels = b.points(t).select(F.col("point_id").alias("label_id"), F.col("label").alias("number"), "x", "y")
    return sp.accept_faces(labels, _faces(t), 12000.0, F.col("number") == 7, base=BASE)


@query(
    "join_segment_intersect",
    b.with_sql(b.SPANS_SQL, body=f"SELECT route_id, wall_id FROM routes, walls WHERE {touch_sql()}"),
)
def segment_intersect(t):
    return sp.segment_hits(b.route_segments(t), b.walls(t), base=BASE, dealt=True, keep=["route_id", "wall_id"])


def _pseg(px, py, ax, ay, bx, by) -> str:
    vv = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    s = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif({vv}, 0)::DOUBLE, 0)))"
    return f"sqrt(({px} - ({ax} + {s} * ({bx} - {ax}))) ** 2 + ({py} - ({ay} + {s} * ({by} - {ay}))) ** 2)"


GAP_SQL = (
    f"CASE WHEN {touch_sql()} THEN 0.0::DOUBLE ELSE least({_pseg('ax', 'ay', 'cx', 'cy', 'dx', 'dy')}, {_pseg('bx', 'by_', 'cx', 'cy', 'dx', 'dy')}, "
    f"{_pseg('cx', 'cy', 'ax', 'ay', 'bx', 'by_')}, {_pseg('dx', 'dy', 'ax', 'ay', 'bx', 'by_')}) END"
)


@query(
    "join_distance_within",
    b.with_sql(
        b.SPANS_SQL,
        f"gaps AS (SELECT route_id, wall_id, {GAP_SQL} AS gap FROM routes, walls)",
        body="SELECT route_id, wall_id, round(gap, 4) AS gap FROM gaps WHERE gap < 6.5",
    ),
)
def distance_within(t):
    near = sp.within_distance(b.route_segments(t), b.walls(t), 6.5, base=BASE, dealt=True)
    return near.select("route_id", "wall_id", F.round("gap", 4).alias("gap"))


def _square(t):
    """Unit areas around every point, so that unions have gaps."""
    p = b.points(t)
    box = p.select(
        F.col("point_id").alias("area_id"),
        (F.col("x") - 40).cast("double").alias("min_x"),
        (F.col("y") - 30).cast("double").alias("min_y"),
        (F.col("x") + 40).cast("double").alias("max_x"),
        (F.col("y") + 30).cast("double").alias("max_y"),
    )
    return box.withColumn("ring", box_ring())


# The part of a segment inside a box is one interval of its parameter; uncovered length remains after
# merging the intervals of all boxes.
CLIP_SQL = """areas AS (SELECT point_id AS area_id, x - 40 AS x0, y - 30 AS y0, x + 40 AS x1, y + 30 AS y1 FROM points),
slabs AS (SELECT route_id, area_id,
  CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 0 ELSE 2 END ELSE least((x0 - ax)::DOUBLE / (bx - ax), (x1 - ax)::DOUBLE / (bx - ax)) END AS xa,
  CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 1 ELSE -1 END ELSE greatest((x0 - ax)::DOUBLE / (bx - ax), (x1 - ax)::DOUBLE / (bx - ax)) END AS xb,
  CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 0 ELSE 2 END ELSE least((y0 - ay)::DOUBLE / (by_ - ay), (y1 - ay)::DOUBLE / (by_ - ay)) END AS ya,
  CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 1 ELSE -1 END ELSE greatest((y0 - ay)::DOUBLE / (by_ - ay), (y1 - ay)::DOUBLE / (by_ - ay)) END AS yb
  FROM routes, areas),
spans AS (SELECT route_id, greatest(0.0, xa, ya) AS lo, least(1.0, xb, yb) AS hi FROM slabs WHERE greatest(0.0, xa, ya) <= least(1.0, xb, yb)),
swept AS (SELECT route_id, lo, hi, max(hi) OVER (PARTITION BY route_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
cover AS (SELECT route_id, min(lo) AS lo, max(hi) AS hi, bool_or(lo > coalesce(reach, 0) + 1e-12) AS gap FROM swept GROUP BY route_id)"""


@query(
    "join_cover_union",
    b.with_sql(
        b.SPANS_SQL,
        b.POINTS_SQL,
        CLIP_SQL,
        body="""SELECT r.route_id FROM routes r LEFT JOIN cover c USING (route_id)
WHERE c.route_id IS NULL OR c.lo > 1e-12 OR c.hi < 1 - 1e-12 OR c.gap""",
    ),
)
def cover_union(t):
    return sp.uncovered_by_union(b.route_segments(t), _square(t), "route_id", ["area_id"], base=BASE)


ZONE_CLIP_SQL = f"""parts AS (SELECT r.route_id, z.zone_id, r.ax, r.ay, r.bx, r.by_,
    -- signed side of both ends against each convex side, outline turning clockwise on screen
    {side_sql('z.cx', 'z.cy', 'z.dx', 'z.dy', 'r.ax', 'r.ay')} AS sa, {side_sql('z.cx', 'z.cy', 'z.dx', 'z.dy', 'r.bx', 'r.by_')} AS sb
  FROM routes r, zone_sides z WHERE z.cx <> z.dx OR z.cy <> z.dy),  -- a repeated vertex bounds no half-plane
limits AS (SELECT route_id, zone_id, any_value(ax) AS ax, any_value(ay) AS ay, any_value(bx) AS bx, any_value(by_) AS by_,
    bool_or(sa <= 0 AND sb <= 0) AS outside,
    max(CASE WHEN sa < 0 AND sb > 0 THEN sa::DOUBLE / (sa - sb) ELSE 0 END) AS lo,
    min(CASE WHEN sa > 0 AND sb < 0 THEN sa::DOUBLE / (sa - sb) ELSE 1 END) AS hi
  FROM parts GROUP BY route_id, zone_id)"""


@query(
    "join_interior_crossing",
    b.with_sql(
        b.SPANS_SQL,
        b.ZONES_SQL,
        ZONE_CLIP_SQL,
        body="""SELECT route_id, zone_id, round((hi - lo) * sqrt((bx - ax) ** 2 + (by_ - ay) ** 2), 4) AS inside
FROM limits WHERE NOT outside AND (hi - lo) * sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) > 0.5""",
    ),
)
def interior_crossing(t):
    inside = sp.interior_overlap(b.route_segments(t), b.zones(t), "route_id", "zone_id", 0.5, base=BASE)
    return inside.select("route_id", "zone_id", F.round("inside", 4).alias("inside"))


def _ells(t):
    """The faces without their upper right quarter."""
    f = _faces(t)
    mx, my = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    x0, y0, x1, y1 = (F.col(c) for c in sp.BOX)
    corners = [(x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1)]
    return f.withColumn("ring", F.array(*[g.point(x, y) for x, y in corners]))


def _shared_sql(a: tuple[str, ...], z: tuple[str, ...]) -> str:
    return (
        f"greatest(0, least({a[2]}, {z[2]}) - greatest({a[0]}, {z[0]})) * greatest(0, least({a[3]}, {z[3]}) - greatest({a[1]}, {z[1]}))"
    )


_WHOLE = {n: tuple(f"{n}.{c}" for c in sp.BOX) for n in "az"}
_CORNER = {n: (f"{n}.mx", f"{n}.my", f"{n}.max_x", f"{n}.max_y") for n in "az"}


@query(
    "join_polygon_overlap",
    b.with_sql(
        FACES_SQL,
        "ells AS (SELECT *, (min_x + max_x) / 2.0::DOUBLE AS mx, (min_y + max_y) / 2.0::DOUBLE AS my FROM faces)",
        f"""shared AS (SELECT a.face_id AS left_id, z.face_id AS right_id, {_shared_sql(_WHOLE['a'], _WHOLE['z'])} - {_shared_sql(_CORNER['a'], _WHOLE['z'])}
  - {_shared_sql(_WHOLE['a'], _CORNER['z'])} + {_shared_sql(_CORNER['a'], _CORNER['z'])} AS area FROM ells a JOIN ells z ON a.face_id < z.face_id)""",
        body="SELECT left_id, right_id, round(CAST(area AS DOUBLE), 4) AS area FROM shared WHERE area >= 1",
    ),
)
def polygon_overlap(t):
    return sp.overlap_pairs(_ells(t), "face_id", 1.0, base=BASE).withColumn("area", F.round("area", 4))


@query(
    "join_bbox_overlap",
    b.with_sql(
        b.PATHS_SQL,
        "crops AS (SELECT n_nationkey AS crop_id, n_nationkey * 150 AS cx0, n_nationkey * 30 AS cy0, n_nationkey * 150 + 250 AS cx1, n_nationkey * 30 + 120 AS cy1 FROM nation)",
        body="""SELECT crop_id, count(*) AS n, string_agg(path_id, ',' ORDER BY path_id) AS path_ids FROM crops JOIN paths
  ON layer IN ('view', 'error') AND x0 < cx1 AND x1 > cx0 AND y0 < cy1 AND y1 > cy0 GROUP BY crop_id""",
    ),
)
def bbox_overlap(t):
    n = F.col("n_nationkey")
    crops = t.nation.select(
        n.alias("crop_id"),
        (n * 150).alias("c_x0"),
        (n * 30).alias("c_y0"),
        (n * 150 + 250).alias("c_x1"),
        (n * 30 + 120).alias("c_y1"),
    )
    hits = sp.bbox_overlap(crops, b.paths(t).filter(F.col("layer").isin("view", "error")), base=32.0)
    return hits.groupBy("crop_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_list("path_id")), ",").alias("path_ids"),
    )


SWING_SQL = f"""swings AS (SELECT vec_id AS swing_id, label AS source_id, {b.dim_sql(0, 1000)} AS hx, {b.dim_sql(1, 1000)} AS hy, 12 + {b.dim_sql(2, 20)} AS radius FROM embeddings),
arcs AS (SELECT *, hx + radius AS ax, hy AS ay, hx AS bx, hy + radius AS by_ FROM swings),
leaves AS (SELECT vec_id AS leaf_id, label AS source_id, {b.dim_sql(0, 1000)} + {b.dim_sql(3, 5)} AS lx0, {b.dim_sql(1, 1000)} AS ly0,
  {b.dim_sql(0, 1000)} + CASE WHEN vec_id % 2 = 0 THEN 12 + {b.dim_sql(2, 20)} ELSE 0 END AS lx1,
  {b.dim_sql(1, 1000)} + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 11 + {b.dim_sql(2, 20)} END AS ly1 FROM embeddings)"""


@query(
    "join_door_leaf",
    b.with_sql(
        SWING_SQL,
        """tried AS (SELECT swing_id, leaf_id, sqrt((lx1 - lx0) ** 2 + (ly1 - ly0) ** 2) AS len, radius,
  least((hx - lx0) ** 2 + (hy - ly0) ** 2, (hx - lx1) ** 2 + (hy - ly1) ** 2) AS hinge_gap,
  least((ax - lx0) ** 2 + (ay - ly0) ** 2, (ax - lx1) ** 2 + (ay - ly1) ** 2) AS a_gap,
  least((bx - lx0) ** 2 + (by_ - ly0) ** 2, (bx - lx1) ** 2 + (by_ - ly1) ** 2) AS b_gap FROM arcs JOIN leaves USING (source_id)),
fits AS (SELECT swing_id, leaf_id, CASE WHEN a_gap < 4 THEN 'end' ELSE 'start' END AS closes_at FROM tried
  WHERE abs(len - radius) <= 2 AND hinge_gap <= 4 AND (a_gap < 4 OR b_gap < 4))""",
        body="SELECT swing_id, min(leaf_id) AS leaf_id, arg_min(closes_at, leaf_id) AS closes_at FROM fits GROUP BY swing_id",
    ),
)
def door_leaf(t):
    key, radius = F.col("vec_id"), (12 + b.dim(2, 20)).cast("double")
    hx, hy = b.dim(0, 1000).cast("double"), b.dim(1, 1000).cast("double")
    swings = t.embeddings.select(
        key.alias("swing_id"),
        F.col("label").alias("source_id"),
        hx.alias("hinge_x"),
        hy.alias("hinge_y"),
        radius.alias("radius"),
        (hx + radius).alias("ax"),
        hy.alias("ay"),
        hx.alias("bx"),
        (hy + radius).alias("by"),
    )
    even = key % 2 == 0
    lines = t.embeddings.select(
        key.alias("leaf_id"),
        key.alias("leaf_ord"),
        F.col("label").alias("source_id"),
        (hx + b.dim(3, 5)).alias("lx0"),
        hy.alias("ly0"),
        (hx + F.when(even, radius).otherwise(0.0)).alias("lx1"),
        (hy + F.when(even, 0.0).otherwise(radius - 1)).alias("ly1"),
    )
    return dw.matched_leaves(swings, lines, base=BASE)


@query(
    "join_nearest_cell",
    b.with_sql(
        b.POINTS_SQL,
        b.holed_sql("points", "label"),
        "cells AS (SELECT DISTINCT CAST(floor(x / 30) AS BIGINT) AS ix, CAST(floor(y / 30) AS BIGINT) AS iy FROM points)",
        f"""near AS (SELECT point_id, ix, iy, (ix * 30 - x) * (ix * 30 - x) + (iy * 30 - y) * (iy * 30 - y) AS d2 FROM points JOIN boxes ON domain_id = label JOIN cells
  ON ix BETWEEN round_even(x / 30.0, 0) - 10 AND round_even(x / 30.0, 0) + 10 AND iy BETWEEN round_even(y / 30.0, 0) - 10 AND round_even(y / 30.0, 0) + 10
  WHERE NOT (x > hx0 AND x < hx1 AND y > hy0 AND y < hy1) AND ix * 30 BETWEEN x0 AND x1 AND iy * 30 BETWEEN y0 AND y1 AND NOT {b.through_sql('x', 'y', '(ix * 30)', '(iy * 30)')}),
best AS (SELECT point_id, min((d2, iy, ix)) AS m FROM near WHERE d2 > 0 GROUP BY point_id)""",
        body="SELECT point_id, m[3] AS ix, m[2] AS iy, round(sqrt(m[1]), 4) AS gap FROM best",
    ),
)
def nearest_cell(t):
    p = b.points(t).withColumnRenamed("label", "domain_id")
    cell = lambda c: F.floor(F.col(c) / 30)
    cells = p.select(cell("x").alias("ix"), cell("y").alias("iy")).distinct()
    snapped = sp.snap_to_grid(p, cells, 30.0, domains=b.holed_domains(b.points(t), "label"), base=BASE)
    return snapped.select("point_id", "ix", "iy", F.round("gap", 4).alias("gap"))
