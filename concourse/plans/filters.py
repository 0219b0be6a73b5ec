"""Projections, filters and predicates (directory, drawing and network rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.functions import text as tx
from concourse.operators import directory as dr
from concourse.operators import drawings as dw
from concourse.operators import network as nw
from concourse.plans import bindings as b
from concourse.plans.registry import query


@query(
    "flt_public_scope",
    b.with_sql(
        b.PLACES_SQL,
        body="SELECT place_id, code, name_en FROM places WHERE is_public AND building_id = 'Brand#7' AND floor_id = 'F2'",
    ),
)
def public_scope(t):
    return dr.visible_places(b.places(t), "Brand#7", "F2").select("place_id", "code", "name_en")


@query(
    "flt_category_facet",
    b.with_sql(b.PLACES_SQL, body="SELECT place_id, category FROM places WHERE category = 'PROMO'"),
)
def category_facet(t):
    return dr.facet(b.places(t), "PROMO").select("place_id", "category")


@query(
    "prj_distinct_categories",
    b.with_sql(b.PLACES_SQL, body="SELECT category, min(place_id) AS first_seen FROM places GROUP BY category"),
)
def distinct_categories(t):
    return dr.categories(b.places(t), "place_id")


LAYERS = ["click", "view", "error"]


@query(
    "flt_layer_allowlist",
    b.with_sql(
        b.PATHS_SQL,
        body="SELECT path_id, layer FROM paths WHERE layer IN ('click','view','error') AND x0 <= 300 AND x1 >= 100 AND y0 <= 700 AND y1 >= 200",
    ),
)
def layer_allowlist(t):
    return dw.keep_paths(b.paths(t), LAYERS, (100, 200, 300, 700)).select("path_id", "layer")


@query(
    "flt_exclusion_box",
    b.with_sql(
        b.PATHS_SQL,
        """exclusions AS (SELECT layer, min(x0) AS x0, min(y0) AS y0, CAST(floor(avg(x1)) AS BIGINT) AS x1, CAST(floor(avg(y1)) AS BIGINT) AS y1
  FROM paths WHERE layer IN ('click','signup') GROUP BY layer)""",
        body="""SELECT path_id, layer FROM paths p WHERE NOT EXISTS (SELECT 1 FROM exclusions e WHERE e.layer = p.layer
  AND e.x0 <= p.x0 AND e.y0 <= p.y0 AND e.x1 >= p.x1 AND e.y1 >= p.y1)""",
    ),
)
def exclusion_box(t):
    paths = b.paths(t)
    boxes = (
        paths.filter(F.col("layer").isin("click", "signup"))
        .groupBy("layer")
        .agg(
            F.min("x0").alias("x0"),
            F.min("y0").alias("y0"),
            F.floor(F.avg("x1")).alias("x1"),
            F.floor(F.avg("y1")).alias("y1"),
        )
    )
    return dw.drop_excluded(paths, boxes).select("path_id", "layer")


@query(
    "prj_affine",
    b.with_sql(b.POINTS_SQL, body="SELECT point_id, 2384 + y * 1.0 AS x, 0.0 - x AS y FROM points").replace(
        "2384 + y * 1.0 AS x, 0.0 - x AS y", "CAST(2384 + y AS DOUBLE) AS x, CAST(-x AS DOUBLE) AS y"
    ),
)
def affine(t):
    x, y = dw.affine(F.col("x").cast("double"), F.col("y").cast("double"), (0, -1, 1, 0, 2384, 0))
    return b.points(t).select("point_id", x.alias("x"), y.alias("y"))


@query(
    "prj_round_coords",
    """SELECT vec_id, round(1000 * CAST(embedding[1] AS DOUBLE), 3) AS x, round(1000 * CAST(embedding[2] AS DOUBLE), 4) AS y
FROM embeddings""",
)
def round_coords(t):
    x, y = (F.lit(1000) * F.col("embedding")[i].cast("double") for i in (0, 1))
    return t.embeddings.select("vec_id", g.round_half_even(x, 3).alias("x"), g.round_half_even(y, 4).alias("y"))




@query(
    "prj_fill_class",
    f"""SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_returnflag <> 'N' AND l_discount * 10 + l_tax * 12.5 + l_quantity / 50 < 2.9 THEN 'shaded' ELSE 'none' END AS fill_class
FROM lineitem""",
)
def fill_class(t):
    channels = F.array(F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50)
    fill = F.when(F.col("l_returnflag") != "N", channels)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", dw.fill_class(fill).alias("fill_class"))


CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN {{n}} IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in dw.CATEGORY_NUMBERS.items()
) + " ELSE 'other' END"


@query(
    "prj_category_from_number",
    f"SELECT p_partkey AS place_id, {CATEGORY_SQL.format(n='p_size')} AS category FROM part",
)
def category_from_number(t):
    return t.part.select(F.col("p_partkey").alias("place_id"), dw.category_of(F.col("p_size")).alias("category"))


@query(
    "prj_code_remap",
    """SELECT p_partkey AS place_id, CASE lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN '007' THEN 8 WHEN '009' THEN 17 WHEN '045' THEN 24
  ELSE p_size END AS number FROM part""",
)
def code_remap(t):
    tag = F.lpad(F.col("p_size").cast("string"), 3, "0")
    return t.part.select(F.col("p_partkey").alias("place_id"), dw.label_number(tag).alias("number"))


@query(
    "prj_canonical_name",
    """SELECT p_partkey AS place_id, upper(p_type[1]) || lower(p_type[2:]) || '&' ||
  upper(split_part(p_name,' ',1)[1]) || split_part(p_name,' ',1)[2:] || ' ' || upper(split_part(p_name,' ',2)[1]) || split_part(p_name,' ',2)[2:] AS name
FROM part""",
)
def canonical_name(t):
    raw = F.concat(F.lit("  "), F.col("p_type"), F.lit("&"), F.replace("p_name", F.lit(" "), F.lit("   ")))
    return t.part.select(F.col("p_partkey").alias("place_id"), tx.canonical_name(raw).alias("name"))


@query(
    "prj_alias_set",
    """SELECT p_partkey AS place_id, array_to_string(list_sort(list_distinct([p_name, p_brand, replace(p_brand, '#', ''), CAST(p_size AS VARCHAR),
  'G ' || p_size, p_brand])), '|') AS aliases FROM part""",
)
def alias_set(t):
    size = F.col("p_size").cast("string")
    variants = dw.alias_set(
        F.col("p_name"),
        F.col("p_brand"),
        F.replace("p_brand", F.lit("#"), F.lit("")),
        size,
        F.concat(F.lit("G "), size),
        F.col("p_brand"),
    )
    return t.part.select(F.col("p_partkey").alias("place_id"), F.array_join(variants, "|").alias("aliases"))


LAYER_OF = {"click": "A-WALL", "view": "A-DOOR-01", "error": "A-DOOR-STEP", "signup": "A-GYPSUM BOARD", "purchase": "A-SITE"}


@query(
    "prj_layer_class",
    """SELECT event_id AS path_id, CASE event_type WHEN 'click' THEN 'wall' WHEN 'signup' THEN 'wall' WHEN 'view' THEN 'door' ELSE 'other' END AS layer_class
FROM events""",
)
def layer_class(t):
    layer = F.lit(None).cast("string")
    for kind, name in LAYER_OF.items():
        layer = F.when(F.col("event_type") == kind, name).otherwise(layer)
    return t.events.select(F.col("event_id").alias("path_id"), dw.layer_class(layer).alias("layer_class"))


@query(
    "flt_evidence_policy",
    b.with_sql(b.NETWORK_SQL, body="SELECT node_id, status FROM nav_nodes WHERE status IN ('confirmed', 'candidate')"),
)
def evidence_policy(t):
    return nw.supported(b.nav_nodes(t), nw.DRAWING)


@query(
    "flt_restriction",
    b.with_sql(b.NETWORK_SQL, body="SELECT edge_id, restriction FROM nav_edges WHERE restriction IN ('open', 'unknown')"),
)
def restriction(t):
    return nw.open_edges(b.nav_edges(t), nw.DRAWING).select("edge_id", "restriction")


@query(
    "flt_accessible",
    b.with_sql(
        b.NETWORK_SQL,
        body="SELECT edge_id, path_type FROM nav_edges WHERE accessibility = 'confirmed' AND path_type <> 'stairs'",
    ),
)
def accessible(t):
    return nw.accessible_edges(b.nav_edges(t)).select("edge_id", "path_type")


CONTROL = ", ".join(f"{b.dim_sql(2 * i + a, 100)} AS {n}{i}" for i in range(4) for a, n in enumerate("xy"))
CONTROL_SQL = f"curves AS (SELECT vec_id, {CONTROL} FROM embeddings)"


def _controls():
    return [(b.dim(2 * i, 100).cast("double"), b.dim(2 * i + 1, 100).cast("double")) for i in range(4)]


SWING_SQL = """swings AS (SELECT *, -(y1 - y0) AS nax, x1 - x0 AS nay, -(y3 - y2) AS nbx, x3 - x2 AS nby FROM curves),
dets AS (SELECT *, nax * nby - nay * nbx AS det, (x3 - x0) * nby - (y3 - y0) * nbx AS num FROM swings),
hinges AS (SELECT *, CASE WHEN abs(det) >= 0.001 THEN x0 + CAST(num AS DOUBLE) / det * nax END AS hx,
  CASE WHEN abs(det) >= 0.001 THEN y0 + CAST(num AS DOUBLE) / det * nay END AS hy FROM dets),
radii AS (SELECT *, sqrt((hx - x0) * (hx - x0) + (hy - y0) * (hy - y0)) AS radius,
  sqrt((hx - x3) * (hx - x3) + (hy - y3) * (hy - y3)) AS radius_b FROM hinges)"""


@query(
    "prj_swing_center",
    b.with_sql(
        CONTROL_SQL,
        SWING_SQL,
        body="SELECT vec_id, round(hx, 4) AS hinge_x, round(hy, 4) AS hinge_y, round(radius, 4) AS radius FROM radii WHERE det <> 0",
    ),
)
def swing_centers(t):
    parts = dw.swing_center(_controls())
    out = t.embeddings.select("vec_id", *[parts[k].alias(k) for k in ("hinge_x", "hinge_y", "radius")])
    return out.filter("radius is not null").select(
        "vec_id", *[F.round(c, 4).alias(c) for c in ("hinge_x", "hinge_y", "radius")]
    )


@query(
    "flt_bad_primitive",
    b.with_sql(
        CONTROL_SQL,
        SWING_SQL,
        body="""SELECT vec_id, sqrt((x3 - x0) * (x3 - x0) + (y3 - y0) * (y3 - y0)) >= 0.001 AS line_ok,
  coalesce(radius BETWEEN 10 AND 65 AND abs(radius_b - radius) <= 2, false) AS swing_ok FROM radii""",
    ),
)
def bad_primitive(t):
    c = _controls()
    parts = dw.swing_center(c)
    line = g.dist(*c[0], *c[3])
    return t.embeddings.select(
        "vec_id",
        dw.usable_line(line).alias("line_ok"),
        dw.usable_swing(parts["radius"], parts["mismatch"]).alias("swing_ok"),
    )


def _bernstein_sql(axis: str) -> str:
    """The curve at parameter i/24 times 24^3, which is a whole number for whole control points."""
    return (
        f"(24-i)*(24-i)*(24-i) * {axis}0 + 3*i*(24-i)*(24-i) * {axis}1 + 3*i*i*(24-i) * {axis}2 + i*i*i * {axis}3"
    )


@query(
    "prj_sample_cubic",
    b.with_sql(
        CONTROL_SQL,
        body=f"""SELECT vec_id, i AS ord, {_bernstein_sql("x")} AS x_scaled, {_bernstein_sql("y")} AS y_scaled
FROM curves, (SELECT unnest(generate_series(0, 24)) AS i)""",
    ),
)
def sample_cubic(t):
    pts = F.array(*[g.point(x, y) for x, y in _controls()])
    curve = t.embeddings.select("vec_id", F.posexplode(dw.sample_points(F.lit("cubic"), pts)).alias("ord", "p"))
    return curve.select(
        "vec_id",
        F.col("ord").cast("long").alias("ord"),
        *[F.round(F.col(f"p.{a}") * 24**3).cast("long").alias(f"{a}_scaled") for a in "xy"],
    )


@query(
    "prj_display_distance",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value + 0.5) AS BIGINT) END AS shown FROM events""",
)
def display_distance(t):
    unit = F.when(F.col("event_type").isin("click", "view"), "meter").otherwise("map-unit")
    return t.events.select("event_id", dr.display_distance(F.col("value"), unit).alias("shown"))


@query(
    "prj_seam_window",
    """WITH src AS (SELECT s_suppkey AS source_id, s_nationkey * 10.0 AS l, 5.0 AS tp, s_nationkey * 10.0 + 400 AS r, 300.0 AS b,
  s_suppkey * 1.5 AS dx, -28.35 AS dy, CASE WHEN s_acctbal >= 0 THEN 'left' ELSE 'right' END AS side FROM supplier)
SELECT source_id, CAST(greatest(l + dx, CASE side WHEN 'right' THEN 350 ELSE 20 END) AS DOUBLE) AS "left", CAST(tp + dy AS DOUBLE) AS top,
  CAST(least(r + dx, CASE side WHEN 'left' THEN 350 ELSE 1020 END) AS DOUBLE) AS "right", CAST(b + dy AS DOUBLE) AS bottom FROM src""",
)
def seam_window(t):
    nation, key = F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double")
    crop = [nation * 10, F.lit(5.0), nation * 10 + 400, F.lit(300.0)]
    view = [F.lit(20.0), F.lit(0.0), F.lit(1000.0), F.lit(800.0)]
    side = F.when(F.col("s_acctbal") >= 0, "left").otherwise("right")
    win = dw.seam_window(crop, (key * 1.5, F.lit(-28.35)), view, F.lit(350.0), side)
    return t.supplier.select(F.col("s_suppkey").alias("source_id"), *[v.alias(k) for k, v in win.items()])


@query(
    "prj_provenance_array",
    """SELECT p_partkey AS place_id, 'schedule#' || p_partkey || '~confirmed|plan#' || p_brand || '~' ||
  CASE WHEN p_size IN (8, 17, 24, 25, 34) THEN 'candidate' ELSE 'confirmed' END || '|outline~' || CASE WHEN p_size > 40 THEN 'unknown' ELSE 'candidate' END AS evidence,
  'Plan label ' || p_name || '.' || CASE WHEN p_size IN (8, 17, 24, 25, 34) THEN ' Conflict ' || p_size ELSE '' END AS plan_note FROM part""",
)
def provenance_array(t):
    key = F.col("p_partkey").cast("string")
    conflict = F.when(
        F.col("p_size").isin(8, 17, 24, 25, 34), F.concat(F.lit(" Conflict "), F.col("p_size").cast("string"))
    )
    note = F.concat(F.lit("Plan label "), "p_name", F.lit("."), F.coalesce(conflict, F.lit("")))
    evidence = dw.provenance(
        [
            (F.concat(F.lit("schedule#"), key), F.lit("schedule"), F.lit("confirmed")),
            (
                F.concat(F.lit("plan#"), F.col("p_brand")),
                note,
                F.when(conflict.isNotNull(), "candidate").otherwise("confirmed"),
            ),
            (F.lit("outline"), F.lit("outline"), F.when(F.col("p_size") > 40, "unknown").otherwise("candidate")),
        ]
    )
    rows = t.part.select(F.col("p_partkey").alias("place_id"), evidence.alias("e"))
    flat = F.array_join(F.transform("e", lambda v: F.concat_ws("~", v["source"], v["status"])), "|")
    return rows.select("place_id", flat.alias("evidence"), F.col("e")[1]["note"].alias("plan_note"))


@query(
    "prj_route_key",
    b.with_sql(
        b.SPANS_SQL,
        body="SELECT route_id, ax || ',' || ay || ';' || bx || ',' || by_ AS route_key FROM routes",
    ),
)
def route_key(t):
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by_").alias("y")))
    key = F.array_join(F.transform(ends, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), ";")
    return b.route_segments(t).select("route_id", key.alias("route_key"))


CONTENT_SQL = "content AS (SELECT doc_id AS content_ref, text AS description FROM documents)"
DEFAULT_TEXT = "A verified description is not yet available."


def _content(t):
    return t.documents.select(F.col("doc_id").alias("content_ref"), F.col("text").alias("description"))


@query(
    "prj_summary_text",
    b.with_sql(
        b.PLACES_SQL,
        CONTENT_SQL,
        body=f"""SELECT place_id, sha256(name_en || '. ' || code || '. ' || CASE WHEN length(description) > 0 THEN description ELSE '{DEFAULT_TEXT}' END) AS summary_hash
FROM places LEFT JOIN content ON place_id = content_ref""",
    ),
)
def summary_text(t):
    rows = dr.with_content(b.places(t).withColumn("content_ref", F.col("place_id")), _content(t), DEFAULT_TEXT)
    spoken = dr.summary_text(rows, "name_en")
    return spoken.select("place_id", F.sha2("summary", 256).alias("summary_hash"))


@query(
    "flt_id_subset",
    b.with_sql(
        b.PATHS_SQL,
        body="""SELECT CAST(source_id AS VARCHAR) || '-path-' || path_id AS path_id, CAST(x0 AS DOUBLE) + 1033.29 AS x0, CAST(y0 AS DOUBLE) - 28.35 AS y0
FROM paths WHERE path_id IN (SELECT p_partkey FROM part WHERE p_size = 7)""",
    ),
)
def id_subset(t):
    named = b.paths(t).withColumn(
        "path_id", F.concat(F.col("source_id").cast("string"), F.lit("-path-"), F.col("path_id").cast("string"))
    )
    wanted = t.part.filter(F.col("p_size") == 7).select(F.col("p_partkey").alias("number"))
    return dw.id_subset(named, wanted, (1033.29, -28.35)).select("path_id", "x0", "y0")


@query(
    "flt_partial_route",
    b.with_sql(
        b.PLACES_SQL,
        body="""SELECT o_orderkey AS route_id, coalesce(a.is_partial, false) OR coalesce(z.is_partial, false) AS is_partial
FROM orders LEFT JOIN places a ON a.place_id = o_custkey LEFT JOIN places z ON z.place_id = o_orderkey""",
    ),
)
def partial_route(t):
    routes = t.orders.select(
        F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("start_place"), F.col("o_orderkey").alias("end_place")
    )
    return dr.partial_routes(routes, b.places(t)).select("route_id", "is_partial")
