"""Aggregations over outlines, tracks, drawing paths and the network."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import measures as ms
from concourse.operators import network as nw
from concourse.operators import relational as rl
from concourse.plans import bindings as b
from concourse.plans import network as net
from concourse.plans.registry import query
from concourse.plans.spatial_joins import PIP_SQL, _hits
from concourse.session import cut

TRACK = ("ts", "event_id")


def track(t):
    return b.marks(t).select("user_id", "ts", "event_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


STEPS_SQL = (
    b.EVENTS_SQL
    + """, hops AS (SELECT user_id, event_id, ts, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM marks
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
segs AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS seg FROM hops)"""
)


@query("agg_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return rl.duplicates(t.lineitem, "l_orderkey", "l_linenumber")


@query(
    "agg_polyline_length",
    b.with_sql(
        STEPS_SQL,
        body="""SELECT user_id, round(CASE WHEN bool_or(event_type = 'error' AND x > 4500) THEN 'NaN'::DOUBLE ELSE coalesce(sum(seg), 0) END, 3) AS length
FROM segs JOIN (SELECT event_id, event_type FROM marks) USING (event_id) GROUP BY user_id""",
    ),
)
def polyline_length(t):
    # Far error positions count as unreadable coordinates.
    bad = (F.col("event_type") == "error") & (F.col("x") > 4500)
    v = b.marks(t).select(
        "user_id",
        "ts",
        "event_id",
        F.when(bad, F.lit(float("nan"))).otherwise(F.col("x").cast("double")).alias("x"),
        F.col("y").cast("double").alias("y"),
    )
    out = ms.polyline_length(v, "user_id", TRACK, b.day_chunk())
    return out.select("user_id", F.round("length", 3).alias("length"))


@query(
    "agg_arc_length_lenient",
    b.with_sql(STEPS_SQL, body="SELECT user_id, round(coalesce(sum(seg), 0), 3) AS length FROM segs GROUP BY user_id"),
)
def arc_length(t):
    out = ms.arc_length(track(t), "user_id", TRACK, b.day_chunk())
    return out.select("user_id", F.round("length", 3).alias("length"))


def zone_vertices(t):
    spread = b.zones(t).select("zone_id", F.posexplode("ring").alias("ord", "p"))
    return spread.select("zone_id", "ord", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query(
    "agg_polygon_area",
    b.with_sql(b.ZONES_SQL, body="SELECT zone_id, CAST(sum(cx * dy - dx * cy) AS DOUBLE) / 2 AS area FROM zone_sides GROUP BY zone_id"),
)
def polygon_area(t):
    return ms.polygon_area(zone_vertices(t), "zone_id")


@query(
    "agg_polygon_bounds",
    b.with_sql(b.EVENTS_SQL, body="SELECT user_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM marks GROUP BY user_id"),
)
def polygon_bounds(t):
    return ms.bounds(b.marks(t), "user_id")


@query(
    "agg_preview_frame",
    b.with_sql(
        b.POINTS_SQL,
        "box AS (SELECT label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY label)",
        "size AS (SELECT *, greatest(x1 - x0 + 70, 220) AS w, greatest(y1 - y0 + 70, 150) AS h FROM box)",
        body="""SELECT label, (x0 + x1) / 2.0::DOUBLE - w / 2.0::DOUBLE AS "left", (y0 + y1) / 2.0::DOUBLE - h / 2.0::DOUBLE AS top,
  CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height FROM size""",
    ),
)
def preview_frame(t):
    return ms.preview_frame(b.points(t), "label")


@query(
    "agg_convex_hull",
    b.with_sql(
        b.POINTS_SQL,
        "u AS (SELECT DISTINCT label, x, y FROM points)",
        # A point is a hull vertex when some line through it leaves every other point strictly on one side:
        # the directions to the others must fit into less than a half turn.
        "dirs AS (SELECT a.label, a.x, a.y, atan2(z.y - a.y, z.x - a.x) AS d FROM u a JOIN u z ON a.label = z.label AND (a.x, a.y) <> (z.x, z.y))",
        body="""SELECT label, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (SELECT label, x, y, max(gap) AS g FROM
  (SELECT label, x, y, CASE WHEN nxt IS NULL THEN f + 2 * pi() ELSE nxt END - d AS gap FROM
    (SELECT label, x, y, d, lead(d) OVER (PARTITION BY label, x, y ORDER BY d) AS nxt, min(d) OVER (PARTITION BY label, x, y) AS f FROM dirs))
  GROUP BY label, x, y) WHERE g > pi() + 1e-9""",
    ),
)
def convex_hull(t):
    return ms.convex_hull(b.points(t), "label").select("label", "x", "y")


@query("agg_layer_counts", "SELECT event_type AS layer, count(*) AS paths FROM events GROUP BY event_type")
def layer_counts(t):
    return ms.layer_counts(b.paths(t))


@query(
    "agg_kept_counts",
    b.with_sql(
        b.PATHS_SQL,
        body="SELECT source_id, count(*) AS paths FROM paths WHERE layer IN ('click','view','error') AND x0 <= 900 AND x1 >= 100 AND y0 <= 700 AND y1 >= 200 GROUP BY source_id",
    ),
)
def kept_counts(t):
    from concourse.operators.drawings import keep_paths

    return ms.layer_counts(keep_paths(b.paths(t), ["click", "view", "error"], (100, 200, 900, 700)), "source_id")


@query(
    "agg_occupants",
    b.with_sql(b.ZONES_SQL, PIP_SQL, body="SELECT zone_id, string_agg(DISTINCT label, ',' ORDER BY label) AS occupants FROM hits GROUP BY zone_id"),
)
def occupants(t):
    found = ms.occupants(_hits(t), "zone_id", "label")
    return found.select("zone_id", F.array_join("occupants", ",").alias("occupants"))


@query(
    "agg_set_equality",
    """WITH members AS (SELECT o_custkey AS building_id, o_orderstatus AS name, list_sort(list_distinct([o_orderpriority, o_orderstatus])) AS floors FROM orders)
SELECT building_id, count(DISTINCT (name, floors)) AS versions FROM members GROUP BY building_id HAVING count(DISTINCT (name, floors)) > 1""",
)
def set_equality(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("building_id"),
        F.col("o_orderstatus").alias("name"),
        F.array("o_orderpriority", "o_orderstatus", "o_orderpriority").alias("floors"),
    )
    return rl.inconsistent_groups(rows, "building_id", "name", "floors")


@query(
    "agg_completeness",
    """WITH codes AS (SELECT doc_id AS number, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM labels),
want AS (SELECT unnest(generate_series(1, (SELECT count(*) FROM documents))) AS number),
seen AS (SELECT number, count(*) AS copies, min(ord) AS first_ord FROM codes GROUP BY number)
SELECT number, CASE WHEN copies IS NULL THEN 'missing' WHEN w.number IS NULL THEN 'unexpected' WHEN copies > 1 THEN 'repeated'
  WHEN first_ord + 1 <> number THEN 'out of order' END AS problem FROM want w FULL JOIN seen s USING (number)
WHERE copies IS NULL OR w.number IS NULL OR copies > 1 OR first_ord + 1 <> number""",
)
def completeness(t):
    from concourse.operators.ordered import ordinal_chunk, row_numbers

    codes = row_numbers(t.labels.select(F.col("doc_id").alias("number")).withColumn("all", F.lit(1)), ["all"], ["number"], ordinal_chunk("number"), "n")
    return rl.sequence_gaps(codes.select("number", (F.col("n") - 1).alias("ord")), t.documents.agg(F.count("*").alias("last")))


@query(
    "agg_pair_coverage",
    net.costs_sql(
        net.NATIONS,
        """SELECT count(*) * (count(*) - 1) AS pairs, (SELECT count(*) FROM best WHERE node IN (SELECT node_id FROM origins) AND source <> node) AS connected,
  count(*) * (count(*) - 1) - (SELECT count(*) FROM best WHERE node IN (SELECT node_id FROM origins) AND source <> node) AS missing FROM origins""",
    ),
)
def pair_coverage(t):
    return rl.pair_coverage(net.all_pairs(t), net._nations(t))


PAIR_COSTS_SQL = f"pair_costs AS ({net.MATRIX})"
ACCESS_SQL = b.NETWORK_SQL.replace("restriction IN ('open', 'unknown')", "restriction IN ('open', 'unknown') AND accessibility = 'confirmed' AND path_type <> 'stairs'")
STEP_FREE_SQL = f"WITH RECURSIVE {ACCESS_SQL},\norigins AS ({net.NATIONS}),\n{net.COSTS_SQL}\n{net.MATRIX}"


def shared_steps(t):
    """Directed steps with the flag of the step-free network, derived once for several matrices."""
    return cut(nw.directed(b.nav_edges(t), nw.DRAWING).select("edge_id", "src", "dst", "cost", nw.step_free().alias("step_free")))


def _compared(t, steps=None, reference=None):
    # Both matrices walk the same steps, which are derived once.
    steps = shared_steps(t) if steps is None else steps
    reference = nw.cost_matrix(steps, net._nations(t)) if reference is None else reference
    step_free = nw.cost_matrix(steps.filter("step_free"), net._nations(t))
    return rl.cost_vs_reference(step_free, reference)


COMPARED_SQL = f"""WITH ref AS ({net.costs_sql(net.NATIONS, net.MATRIX)}), own AS ({STEP_FREE_SQL}),
compared AS (SELECT start_node, end_node, own.cost, ref.cost AS reference_cost, own.cost::DOUBLE / ref.cost AS ratio,
  own.cost IS NULL OR own.cost > ref.cost + 0.05 AS failed FROM ref LEFT JOIN own USING (start_node, end_node))"""


@query(
    "join_pairs_reference",
    COMPARED_SQL + " SELECT start_node, end_node, cost, reference_cost, round(ratio, 6) AS ratio, failed FROM compared",
)
def pairs_reference(t, steps=None, reference=None):
    return _compared(t, steps, reference).select(
        "start_node", "end_node", "cost", "reference_cost", F.round("ratio", 6).alias("ratio"), "failed"
    )


@query(
    "agg_cost_ratio",
    COMPARED_SQL + " SELECT round(max(ratio), 6) AS max_ratio, count(*) FILTER (WHERE failed) AS failures FROM compared",
)
def cost_ratio(t):
    return rl.max_ratio(_compared(t)).select(F.round("max_ratio", 6).alias("max_ratio"), "failures")


@query(
    "agg_cycle_rank",
    b.with_sql(
        b.NETWORK_SQL,
        body="SELECT (SELECT count(*) FROM nav_edges) AS edges, (SELECT count(*) FROM nav_nodes) AS nodes, (SELECT count(*) FROM nav_edges) - (SELECT count(*) FROM nav_nodes) + 1 AS cycles",
    ),
)
def cycle_rank(t):
    return ms.cycle_rank(b.nav_nodes(t), b.nav_edges(t))


@query(
    "agg_endpoint_kinds",
    """SELECT coalesce(CASE WHEN p_size <> 13 THEN p_type END, 'unknown') AS kind, count(*) AS endpoints, count(*) FILTER (WHERE p_size > 40) AS qualified
FROM part GROUP BY 1""",
)
def endpoint_kinds(t):
    rows = t.part.select(
        F.when(F.col("p_size") != 13, F.col("p_type")).alias("kind"), F.when(F.col("p_size") > 40, F.col("p_name")).alias("note")
    )
    return ms.endpoint_kinds(rows, "kind", "note")


@query(
    "agg_evidence_gate",
    """WITH e AS (SELECT o_custkey AS graph_id, 'confirmed' AS graph_status, CASE WHEN o_orderpriority = '1-URGENT' THEN 'candidate' ELSE 'confirmed' END AS status FROM orders)
SELECT graph_id, max(graph_status) AS graph_status, count(*) FILTER (WHERE status <> 'confirmed') AS unconfirmed, max(graph_status) <> 'confirmed' OR bool_and(status = 'confirmed') AS passes
FROM e GROUP BY graph_id""",
)
def evidence_gate(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("graph_id"),
        F.lit("confirmed").alias("graph_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "candidate").otherwise("confirmed").alias("status"),
    )
    return ms.evidence_gate(rows, "graph_id")


@query(
    "agg_geometry_summary",
    """WITH g AS (SELECT CASE WHEN p_size > 40 THEN 'unknown' WHEN p_type = 'PROMO' THEN 'confirmed' ELSE 'candidate' END AS s FROM part)
SELECT count(*) AS places, count(*) FILTER (WHERE s <> 'unknown') AS with_outline, count(*) FILTER (WHERE s = 'unknown') AS unresolved,
  count(*) FILTER (WHERE s = 'confirmed') AS confirmed FROM g""",
)
def geometry_summary(t):
    status = F.when(F.col("p_size") > 40, "unknown").when(F.col("p_type") == "PROMO", "confirmed").otherwise("candidate")
    return ms.geometry_summary(t.part.select(status.alias("geometry_status")))
