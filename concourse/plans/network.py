"""Graph queries on the network derived from suppliers, parts, nations and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.functions.geometry import point as pt
from concourse.operators import grid as gd
from concourse.operators import instructions as ins
from concourse.operators import network as nw
from concourse.operators import routing as rt
from concourse.plans import bindings as b
from concourse.plans.registry import query
from concourse.session import cut


def _steps(t, accessible: bool = False):
    return nw.directed(b.nav_edges(t), nw.DRAWING, accessible).select("edge_id", "src", "dst", "cost")


def _nations(t):
    return t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"))


@query("gr_directed_edges", b.with_sql(b.NETWORK_SQL, body="SELECT edge_id, src, dst, cost FROM directed"))
def directed_edges(t):
    return _steps(t)


COSTS_SQL = """best(source, node, cost) USING KEY (source, node) AS (
  SELECT node_id, node_id, CAST(0 AS BIGINT) FROM origins
  UNION
  (SELECT b.source, d.dst, min(b.cost + d.cost) AS cost
   FROM best b JOIN directed d ON b.node = d.src
   LEFT JOIN recurring.best r ON r.source = b.source AND r.node = d.dst
   WHERE b.cost + d.cost < coalesce(r.cost, 9223372036854775807)
   GROUP BY b.source, d.dst))"""


def costs_sql(origins: str, body: str) -> str:
    return f"WITH RECURSIVE {b.NETWORK_SQL},\norigins AS ({origins}),\n{COSTS_SQL}\n{body}"


ONE_ORIGIN = "SELECT 'N0' AS node_id"
NATIONS = "SELECT 'N' || n_nationkey AS node_id FROM nation"


@query("gr_shortest_costs", costs_sql(ONE_ORIGIN, "SELECT source, node, cost FROM best"))
def shortest_costs(t):
    origin = t.nation.filter(F.col("n_nationkey") == 0).select(F.lit("N0").alias("source"))
    return nw.shortest_costs(_steps(t), origin).select("source", "node", "cost")


MATRIX = "SELECT source AS start_node, node AS end_node, cost FROM best WHERE node IN (SELECT node_id FROM origins) AND source <> node"


@query("gr_all_pairs", costs_sql(NATIONS, MATRIX))
def all_pairs(t):
    return nw.cost_matrix(_steps(t), _nations(t))


WEIGHED_SQL = COSTS_SQL.replace("d.cost", "(d.cost * 100000 + 1)")


@query(
    "gr_shortest_paths",
    f"""WITH RECURSIVE {b.NETWORK_SQL},
origins AS ({NATIONS}),
{WEIGHED_SQL}
SELECT source || '>' || node AS route_id, cost % 100000 AS steps, cost // 100000 AS cost FROM best WHERE node IN (SELECT node_id FROM origins) AND source <> node""",
)
def shortest_paths(t):
    """Every nation-to-nation path, folded to its step count and summed step costs."""
    steps = _steps(t)
    tree = cut(nw.shortest_tree(steps, _nations(t).select(F.col("node_id").alias("source"))))
    ends = _nations(t).select(F.col("node_id").alias("target"))
    wanted = tree.filter("hops > 0").join(ends, F.col("node") == F.col("target"), "left_semi")
    wanted = wanted.select(F.concat_ws(">", "source", "node").alias("route_id"), "source", F.col("node").alias("target"))
    walked = nw.path_steps(tree, wanted)
    costs = steps.select("edge_id", F.col("src").alias("from_node"), F.col("dst").alias("to_node"), "cost")
    full = walked.join(costs, ["edge_id", "from_node", "to_node"])
    return full.groupBy("route_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("cost").alias("cost"))


@query(
    "gr_reachability",
    f"""WITH RECURSIVE {b.NETWORK_SQL},
links AS (SELECT from_node AS a, to_node AS z FROM nav_edges UNION SELECT to_node, from_node FROM nav_edges),
seen AS (SELECT 'R0' AS node UNION SELECT z FROM seen JOIN links ON node = a)
SELECT node FROM seen""",
)
def reachability(t):
    root = t.region.filter("r_regionkey = 0").select(F.lit("R0").alias("node_id"))
    return nw.reachable(b.nav_edges(t), root)


def relax_sql(name: str, origins: str, steps: str, weight: str) -> str:
    """A keyed recursion for cheapest costs over another step table."""
    return COSTS_SQL.replace("best", name).replace("FROM origins", f"FROM {origins}").replace("JOIN directed d", f"JOIN {steps} d").replace("d.cost", weight)


@query(
    "gr_tree_control",
    f"""WITH RECURSIVE {b.NETWORK_SQL},
origins AS ({NATIONS}),
root AS ({ONE_ORIGIN}),
{relax_sql("rooted", "root", "directed", "(d.cost * 100000 + 1)")},
parents AS (SELECT r.node, min((d.src, d.edge_id)) AS p FROM rooted r JOIN directed d ON d.dst = r.node JOIN rooted q ON q.node = d.src
  WHERE q.cost + d.cost * 100000 + 1 = r.cost GROUP BY r.node),
tree AS (SELECT d.src, d.dst, d.cost FROM parents JOIN directed d ON d.dst = node AND d.src = p[1] AND d.edge_id = p[2]),
pruned AS (SELECT src, dst, cost FROM tree UNION ALL SELECT dst, src, cost FROM tree),
{COSTS_SQL},
{relax_sql("limited", "origins", "pruned", "d.cost")}
SELECT f.source AS start_node, f.node AS end_node, f.cost, l.cost AS tree_cost, l.cost IS NULL OR l.cost > f.cost + 0.05 AS worse
FROM best f LEFT JOIN limited l USING (source, node) WHERE f.node IN (SELECT node_id FROM origins) AND f.source <> f.node""",
)
def tree_control(t, steps=None, full=None):
    root = t.nation.filter("n_nationkey = 0").select(F.lit("N0").alias("node_id"))
    steps = _steps(t) if steps is None else steps
    return nw.tree_detours(steps, root, _nations(t), full=full).select("start_node", "end_node", "cost", "tree_cost", "worse")


@query(
    "gr_detour_via",
    costs_sql(
        NATIONS,
        f""", matrix AS ({MATRIX}),
trips AS (SELECT 'N' || a.n_nationkey AS s, 'N' || z.n_nationkey AS e FROM nation a JOIN nation z ON a.n_regionkey = z.n_regionkey AND a.n_nationkey <> z.n_nationkey WHERE a.n_nationkey > 0 AND z.n_nationkey > 0)
SELECT s AS start_node, e AS end_node, d.cost AS direct, f.cost + l.cost AS via_cost, round(d.cost::DOUBLE / (f.cost + l.cost), 6) AS ratio
FROM trips JOIN matrix d ON d.start_node = s AND d.end_node = e JOIN matrix f ON f.start_node = s AND f.end_node = 'N0' JOIN matrix l ON l.start_node = 'N0' AND l.end_node = e""",
    ).replace("GROUP BY b.source, d.dst))\n, matrix", "GROUP BY b.source, d.dst)),\nmatrix"),
)
def detour_via(t, matrix=None):
    a = t.nation.filter("n_nationkey > 0").select("n_regionkey", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("start_node"))
    z = t.nation.filter("n_nationkey > 0").select("n_regionkey", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("end_node"))
    trips = a.join(z, "n_regionkey").filter("start_node <> end_node").select("start_node", F.lit("N0").alias("stop_node"), "end_node")
    out = nw.via(cut(all_pairs(t)) if matrix is None else matrix, trips)
    return out.select("start_node", "end_node", "direct", "via_cost", F.round("ratio", 6).alias("ratio"))


LINKS_SQL = """steps_in AS (SELECT user_id, event_id, event_type, ts, x, y, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id,
  abs(lead(x) OVER w - x) + abs(lead(y) OVER w - y) AS length FROM marks WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _track_links(t):
    """Undirected links between successive events of a user; sign-ups are stops."""
    from concourse.operators.ordered import neighbours

    m = neighbours(b.marks(t), ["user_id"], ["ts", "event_id"], b.day_chunk(), next={"nx": "x", "ny": "y", "next_id": "event_id"})
    length = F.abs(F.col("nx") - F.col("x")) + F.abs(F.col("ny") - F.col("y"))
    links = m.filter("next_id is not null").select(F.col("event_id").alias("from_node"), F.col("next_id").alias("to_node"), length.alias("length"))
    stops = t.events.filter("event_type = 'signup'").select(F.col("event_id").alias("node_id"))
    return links, stops


@query(
    "gr_special_vertices",
    b.with_sql(
        b.EVENTS_SQL,
        LINKS_SQL,
        body="SELECT event_id AS node_id FROM steps_in WHERE event_type = 'signup' OR ((prev_id IS NULL) <> (next_id IS NULL))",
    ),
)
def special_vertices(t):
    links, stops = _track_links(t)
    return nw.special_vertices(links, stops)


@query(
    "gr_contract_chains",
    b.with_sql(
        b.EVENTS_SQL,
        LINKS_SQL,
        """stopped AS (SELECT *, sum(CASE WHEN event_type = 'signup' OR prev_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part
  FROM steps_in WHERE next_id IS NOT NULL),
chains AS (SELECT arg_min(event_id, (ts, event_id)) AS a, arg_max(next_id, (ts, event_id)) AS z, sum(length) AS length, count(*) AS parts FROM stopped GROUP BY user_id, part)""",
        body="SELECT least(a, z) AS start_node, greatest(a, z) AS end_node, CAST(length AS BIGINT) AS length, parts FROM chains",
    ),
)
def contract(t):
    links, stops = _track_links(t)
    links = cut(links)
    edges, _ = nw.contract_chains(links, cut(nw.special_vertices(links, stops)))
    return edges.select("start_node", "end_node", "length", "parts")


# ---------------------------------------------------------------- grids

BOXES_SQL = (
    b.EVENTS_SQL
    + ", "
    + b.holed_sql("marks", "user_id")
    + """,
xs AS (SELECT *, unnest(generate_series(CAST(floor(x0 / 100) AS BIGINT), CAST(floor(x1 / 100) AS BIGINT) + 1)) AS ix FROM boxes),
lattice AS (SELECT *, unnest(generate_series(CAST(floor(y0 / 100) AS BIGINT), CAST(floor(y1 / 100) AS BIGINT) + 1)) AS iy FROM xs),
cells AS (SELECT *, least(ix * 100 - x0, x1 - ix * 100, iy * 100 - y0, y1 - iy * 100,
    sqrt(greatest(hx0 - ix * 100, 0, ix * 100 - hx1) ** 2 + greatest(hy0 - iy * 100, 0, iy * 100 - hy1) ** 2)) AS clearance FROM lattice
  WHERE ix * 100 > x0 AND ix * 100 < x1 AND iy * 100 > y0 AND iy * 100 < y1 AND NOT (ix * 100 BETWEEN hx0 AND hx1 AND iy * 100 BETWEEN hy0 AND hy1))"""
)
GRID = 100.0


def _domains(t):
    return b.holed_domains(b.marks(t), "user_id")


@query("gr_grid_cells", b.with_sql(BOXES_SQL, body="SELECT domain_id, ix, iy FROM cells"))
def grid_cells(t):
    return gd.grid_cells(_domains(t), GRID).select("domain_id", "ix", "iy")


@query("gr_clearance", b.with_sql(BOXES_SQL, body="SELECT domain_id, ix, iy, round(CAST(clearance AS DOUBLE), 4) AS clearance FROM cells"))
def clearance(t):
    domains = _domains(t)
    found = gd.clearance(gd.grid_cells(domains, GRID), domains, GRID)
    return found.select("domain_id", "ix", "iy", F.round("clearance", 4).alias("clearance"))


@query(
    "gr_grid_links",
    b.with_sql(
        BOXES_SQL,
        "offsets AS (SELECT unnest([1, 0, 1, -1]) AS dx, unnest([0, 1, 1, 1]) AS dy)",
        body=f"""SELECT a.domain_id, a.ix AS ix0, a.iy AS iy0, z.ix AS ix1, z.iy AS iy1, round(100 * sqrt(dx * dx + dy * dy), 4) AS length,
  round(100 * sqrt(dx * dx + dy * dy) * (1 + 8.0::DOUBLE / greatest(least(a.clearance, z.clearance), 0.25)), 4) AS cost
FROM cells a, offsets JOIN cells z ON z.domain_id = a.domain_id AND z.ix = a.ix + dx AND z.iy = a.iy + dy
WHERE NOT {b.through_sql('(a.ix * 100)', '(a.iy * 100)', '((a.ix + dx) * 100)', '((a.iy + dy) * 100)').replace('hx', 'a.hx').replace('hy', 'a.hy')}""",
    ),
)
def grid_links(t):
    domains = _domains(t)
    cells = gd.clearance(gd.grid_cells(domains, GRID), domains, GRID)
    links = gd.grid_links(cut(cells), domains, GRID)
    return links.withColumns({"length": F.round("length", 4), "cost": F.round("cost", 4)})


# Doors of label 3 have no segment and fall back to a point; paths are hops between neighbouring vertices from the lowest one.
HOPS = 60
OFFSETS_SQL = f"""doors AS (SELECT r.route_id AS door_id, r.label, CASE WHEN r.label <> 3 THEN ax END AS ax, CASE WHEN r.label <> 3 THEN ay END AS ay,
  CASE WHEN r.label <> 3 THEN bx END AS bx, CASE WHEN r.label <> 3 THEN by_ END AS by_, p.x AS fx, p.y AS fy FROM routes r JOIN points p ON point_id = route_id),
segments AS (SELECT *, (ax + bx) / 2.0::DOUBLE AS mx, (ay + by_) / 2.0::DOUBLE AS my, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS len, -(by_ - ay) AS nx, bx - ax AS ny
  FROM doors WHERE ax <> bx OR ay <> by_),
offsets AS (SELECT unnest([2, 4, 6, 10, 15, 22, 30, -2, -4, -6, -10, -15, -22, -30]) AS v),
spots AS (SELECT door_id, label, v, mx + nx / len * v AS x, my + ny / len * v AS y FROM segments, offsets
  UNION ALL SELECT door_id, label, 0, fx, fy FROM doors WHERE ax IS NULL OR (ax = bx AND ay = by_)),
within AS (SELECT s.*, hx0, hy0, hx1, hy1, x0, y0, x1, y1 FROM spots s JOIN boxes ON domain_id = label WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND NOT (x > hx0 AND x < hx1 AND y > hy0 AND y < hy1)),
verts AS (SELECT DISTINCT CAST(floor(x / 30) AS BIGINT) AS ix, CAST(floor(y / 30) AS BIGINT) AS iy FROM points),
walk AS (SELECT m[2] AS ix, m[1] AS iy, 0 AS hops FROM (SELECT min((iy, ix)) AS m FROM verts)
  UNION SELECT v.ix, v.iy, hops + 1 FROM walk w JOIN verts v ON abs(v.ix - w.ix) <= 1 AND abs(v.iy - w.iy) <= 1 AND (v.ix <> w.ix OR v.iy <> w.iy) WHERE hops < {HOPS}),
far AS (SELECT ix, iy, min(hops) AS path_distance FROM walk GROUP BY ix, iy),
near AS (SELECT door_id, v, x, y, ix, iy, sqrt((ix * 30 - x) ** 2 + (iy * 30 - y) ** 2) AS gap FROM within JOIN verts
  ON abs(ix - round_even(x / 30, 0)) <= 10 AND abs(iy - round_even(y / 30, 0)) <= 10
  WHERE ix * 30 BETWEEN x0 AND x1 AND iy * 30 BETWEEN y0 AND y1 AND NOT {b.through_sql('x', 'y', '(ix * 30)', '(iy * 30)')}),
snapped AS (SELECT door_id, v, x, y, min((gap, iy, ix)) AS m FROM near WHERE gap > 0.001 GROUP BY ALL),
best AS (SELECT door_id, min((abs(v), path_distance, x, y, m[2], m[3])) AS o FROM snapped JOIN far ON far.ix = m[3] AND far.iy = m[2] GROUP BY door_id)"""


@query(
    "gr_endpoint_candidates",
    b.with_sql(
        b.SPANS_SQL,
        b.POINTS_SQL,
        b.holed_sql("points", "label"),
        OFFSETS_SQL,
        body="""SELECT d.door_id, o IS NOT NULL AS found, CAST(o[1] AS DOUBLE) AS door_distance, o[2] AS path_distance, round(o[3], 4) AS x, round(o[4], 4) AS y, o[5] AS iy, o[6] AS ix
FROM doors d LEFT JOIN best USING (door_id)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def endpoint_candidates(t):
    points = b.points(t)
    real = [F.when(F.col("label") != 3, F.col(c)).cast("double").alias(c) for c in ("ax", "ay", "bx", "by_")]
    doors = b.route_segments(t).select(F.col("route_id").alias("door_id"), F.col("label").alias("domain_id"), *real)
    doors = doors.join(points.select(F.col("point_id").alias("door_id"), F.col("x").alias("fx"), F.col("y").alias("fy")), "door_id")
    cell = lambda c: F.floor(F.col(c) / 30)
    verts = cut(points.select(cell("x").alias("ix"), cell("y").alias("iy")).distinct())
    name = lambda x, y: F.concat_ws(",", x, y)
    beside = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    steps = verts.withColumn("o", beside).select("ix", "iy", (F.col("ix") + F.col("o.i")).alias("jx"), (F.col("iy") + F.col("o.j")).alias("jy"))
    steps = steps.join(verts.withColumnsRenamed({"ix": "jx", "iy": "jy"}), ["jx", "jy"]).select(
        name("ix", "iy").alias("src"), name("jx", "jy").alias("dst"), F.lit(1).cast("long").alias("cost"), name("jx", "jy").alias("edge_id")
    )
    lowest = verts.agg(F.min(F.struct("iy", "ix")).alias("m")).select(name(F.col("m.ix"), F.col("m.iy")).alias("source"))
    reached = nw.shortest_costs(steps, lowest).filter(F.col("cost") <= HOPS).select("node", F.col("cost").alias("path_distance"))
    verts = verts.join(reached, name("ix", "iy") == F.col("node"), "left").select("ix", "iy", "path_distance")
    best = gd.choose_endpoints(doors, b.holed_domains(points, "label"), verts, 30.0, base=8.0)
    return best.select("door_id", "found", "door_distance", "path_distance", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "iy", "ix")


# ---------------------------------------------------------------- floor graphs: one per nation and market segment

FLOORS_SQL = """floor_nodes AS (
  SELECT c_nationkey || '/' || c_mktsegment AS bundle_id, 'C' || c_custkey AS id, CASE WHEN c_acctbal > 9000 THEN 'candidate' ELSE 'confirmed' END AS status FROM customer
  UNION ALL SELECT DISTINCT c_nationkey || '/' || c_mktsegment, 'H', 'confirmed' FROM customer),
floor_edges AS (SELECT c_nationkey || '/' || c_mktsegment AS bundle_id, 'E' || c_custkey AS id, 'C' || c_custkey AS a,
  CASE WHEN c_acctbal < -950 THEN c_acctbal ELSE 10 + c_custkey END AS distance, CASE WHEN c_acctbal BETWEEN 0 AND 500 THEN 'closed' ELSE 'open' END AS restriction,
  CASE WHEN c_acctbal BETWEEN 500 AND 2000 THEN 'unknown' ELSE 'confirmed' END AS accessibility, c_acctbal > 8000 AND c_acctbal < 8400 AS unplugged FROM customer),
live AS (SELECT e.*, n.status FROM floor_edges e JOIN floor_nodes n ON n.bundle_id = e.bundle_id AND n.id = e.a WHERE restriction = 'open' AND n.status = 'confirmed'),
faults AS (SELECT bundle_id, id AS element, 'bad distance' AS fault FROM live WHERE distance < 0
  UNION ALL SELECT bundle_id, id, 'loose geometry' FROM live WHERE unplugged)"""


def _floor_tables(t):
    """Star graphs: a hub per nation and segment, one door edge per customer.

    Customers far in debt give broken distances, a band of balances gives geometry that misses its node.
    """
    c = t.customer.withColumn("bundle_id", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    key = F.col("c_custkey").cast("string")
    here, hub = pt(F.col("c_custkey") + 10, F.lit(0)), pt(F.lit(0), F.lit(0))
    node = lambda i, p, s: [
        "bundle_id", i.alias("id"), F.lit("B").alias("buildingId"), F.lit("F").alias("floorId"), p.alias("xy"),
        F.lit("junction").alias("type"), F.lit(None).cast("string").alias("roomId"), s.alias("status"),
    ]
    customers = c.select(*node(F.concat(F.lit("C"), key), here, F.when(F.col("c_acctbal") > 9000, "candidate").otherwise("confirmed")))
    hubs = c.select("bundle_id").distinct().select(*node(F.lit("H"), hub, F.lit("confirmed")))
    balance = F.col("c_acctbal")
    astray = pt(F.col("c_custkey") + 10, F.lit(1))
    unplugged = (balance > 8000) & (balance < 8400)
    edges = c.select(
        "bundle_id",
        F.concat(F.lit("E"), key).alias("id"),
        F.concat(F.lit("C"), key).alias("from"),
        F.lit("H").alias("to"),
        F.lit("F").alias("floorId"),
        F.lit("corridor").alias("pathType"),
        F.when(balance < -950, balance).otherwise((F.col("c_custkey") + 10).cast("double")).alias("distance"),
        F.lit("map-unit").alias("distanceUnit"),
        F.when(balance.between(500, 2000), "unknown").otherwise("confirmed").alias("accessibility"),
        F.when(balance.between(0, 500), "closed").otherwise("open").alias("restriction"),
        F.lit("confirmed").alias("status"),
        F.lit(True).alias("bidirectional"),
        F.array(F.when(unplugged, astray).otherwise(here), hub).alias("path"),
    )
    graphs = c.select("bundle_id").distinct().select(
        "bundle_id",
        F.lit(None).cast("string").alias("policy"),
        F.lit(None).cast("double").alias("meters_per_unit"),
        F.lit("unknown").alias("calibration_status"),
        F.when(F.col("bundle_id").like("%/BUILDING"), "confirmed").otherwise("candidate").alias("status"),
        F.lit(0).alias("n_areas"),
        F.lit(0).alias("n_walls"),
    )
    spark = t.spark
    areas = spark.createDataFrame([], "bundle_id string, ord int, ring array<struct<x:double,y:double>>")
    walls = spark.createDataFrame([], "bundle_id string, ord int, path array<struct<x:double,y:double>>")
    return {"nodes": customers.unionByName(hubs), "edges": edges, "graphs": graphs, "areas": areas, "walls": walls}


@query("gr_graph_health", b.with_sql(FLOORS_SQL, body="SELECT bundle_id, element, fault FROM faults"))
def graph_health(t):
    return rt.graph_violations(_floor_tables(t), geometry=False)


@query(
    "gr_route_status",
    b.with_sql(
        FLOORS_SQL,
        """asked AS (SELECT o_orderkey AS route_id, c_nationkey || '/' || c_mktsegment AS bundle_id, CASE WHEN o_orderpriority <> '5-LOW' THEN 'C' || c_custkey END AS s,
  CASE o_orderstatus WHEN 'O' THEN 'H' WHEN 'F' THEN 'C' || o_orderkey END AS e, o_orderpriority = '1-URGENT' AS accessible FROM orders JOIN customer ON o_custkey = c_custkey),
joined AS (SELECT a.*, a.bundle_id LIKE '%/BUILDING' AS sealed, a.bundle_id IN (SELECT bundle_id FROM faults) AS broken, sn.status AS s_status, en.status AS e_status,
    CASE WHEN s = e OR s = 'H' THEN 0 WHEN se.accessibility = 'confirmed' OR NOT accessible THEN se.distance END AS s_leg,
    CASE WHEN e = 'H' OR s = e THEN 0 WHEN ee.accessibility = 'confirmed' OR NOT accessible THEN ee.distance END AS e_leg
  FROM asked a LEFT JOIN floor_nodes sn ON sn.bundle_id = a.bundle_id AND sn.id = s LEFT JOIN floor_nodes en ON en.bundle_id = a.bundle_id AND en.id = e
  LEFT JOIN live se ON se.bundle_id = a.bundle_id AND se.a = s LEFT JOIN live ee ON ee.bundle_id = a.bundle_id AND ee.a = e),
judged AS (SELECT *, CASE WHEN s IS NULL THEN 'unavailable:start' WHEN e IS NULL THEN 'unavailable:destination' WHEN broken THEN 'invalid:invalid'
  WHEN s_status IS NULL OR e_status IS NULL THEN CASE WHEN sealed THEN 'invalid:missing' ELSE 'unconfirmed:unconfirmed' END
  WHEN s_status <> 'confirmed' OR e_status <> 'confirmed' THEN 'unconfirmed:unconfirmed'
  WHEN s_leg + e_leg IS NOT NULL THEN 'ok:' WHEN accessible THEN 'unavailable:accessible' WHEN sealed THEN 'unavailable:disconnected' ELSE 'unconfirmed:unconfirmed' END AS outcome FROM joined)""",
        body="""SELECT route_id, split_part(outcome, ':', 1) AS status, nullif(split_part(outcome, ':', 2), '') AS reason,
  CASE WHEN outcome = 'ok:' THEN CAST(s_leg + e_leg AS DOUBLE) ELSE 0.0::DOUBLE END AS distance FROM judged""",
    ),
)
def route_status(t):
    c = t.customer.select("c_custkey", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("bundle_id"))
    asked = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("route_id"),
        "bundle_id",
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("start_node"),
        F.when(F.col("o_orderstatus") == "O", "H")
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("C"), F.col("o_orderkey").cast("string")))
        .alias("end_node"),
        (F.col("o_orderpriority") == "1-URGENT").alias("accessible"),
    )
    outcome, _ = rt.route_requests(asked, _floor_tables(t), geometry=False)
    return outcome.select("route_id", "status", "reason", "distance")


@query(
    "gr_path_validation",
    b.with_sql(
        b.NETWORK_SQL,
        """seqs AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber AS path_id, 'S' || s_suppkey AS n1, 'N' || c_nationkey AS n2, 'R' || n_regionkey AS n3, 'D' || s_suppkey AS e1, 'E' || n_nationkey AS e2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)""",
        body="""SELECT path_id FROM seqs JOIN nav_nodes ON node_id = n1 AND status = 'confirmed' JOIN directed a ON a.edge_id = e1 AND a.src = n1 AND a.dst = n2
JOIN directed z ON z.edge_id = e2 AND z.src = n2 AND z.dst = n3""",
    ),
)
def path_validation(t):
    """A claimed supplier-nation-region path per line item, right only where customer and supplier share the nation."""
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    claims = (
        t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(t.nation.select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("s_nationkey"))
    )
    sequences = claims.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("path_id"),
        F.array(tag("S", "s_suppkey"), tag("N", "c_nationkey"), tag("R", "n_regionkey")).alias("nodes"),
        F.array(tag("D", "s_suppkey"), tag("E", "n_nationkey")).alias("edges"),
    )
    starts = nw.supported(b.nav_nodes(t), nw.VERIFIED)
    return rt.valid_paths(sequences, _steps(t), starts)


PATH_TYPES = {"click": "corridor", "view": "door", "error": "stairs", "signup": "corridor", "purchase": "entrance"}


def track_steps(t):
    """Event tracks as route steps: the event type gives the kind of connection, a corner point the bend."""
    from concourse.operators.ordered import neighbours, ordinal_chunk, row_numbers

    numbered = row_numbers(b.marks(t), ["user_id"], ["ts", "event_id"], b.day_chunk(), "ord")
    m = neighbours(
        numbered, ["user_id"], ["ord"], ordinal_chunk("ord"),
        next={"nx": "x", "ny": "y", "next_id": "event_id", "next_ts": "ts", "next_type": "event_type"},
    ).filter("next_id is not null")
    kind = F.lit(None).cast("string")
    for event, path_type in PATH_TYPES.items():
        kind = F.when(F.col("event_type") == event, path_type).otherwise(kind)
    corner = pt(F.col("nx"), F.col("y"))
    return m.select(
        F.col("user_id").alias("route_id"),
        "ord",
        F.col("event_id").cast("string").alias("from_node"),
        F.col("next_id").cast("string").alias("to_node"),
        F.to_date("ts").cast("string").alias("from_floor"),
        F.to_date("next_ts").cast("string").alias("to_floor"),
        F.when(F.col("event_type") == "purchase", "entrance").otherwise("junction").alias("from_type"),
        F.when(F.col("next_type") == "purchase", "door").otherwise("junction").alias("to_type"),
        F.lit(None).cast("string").alias("to_room"),
        kind.alias("path_type"),
        (F.abs(F.col("nx") - F.col("x")) + F.abs(F.col("ny") - F.col("y"))).cast("double").alias("cost"),
        F.array(pt(F.col("x"), F.col("y")), corner, pt(F.col("nx"), F.col("ny"))).alias("path"),
    )


def _turn_sql(ux: str, uy: str, vx: str, vy: str) -> str:
    angle = f"degrees(atan2(({ux} * {vy} - {uy} * {vx})::DOUBLE, ({ux} * {vx} + {uy} * {vy})::DOUBLE))"
    return f"""CASE WHEN abs({angle}) < 15 - 1e-7 THEN 'continue' WHEN abs({angle}) < 45 - 1e-7 THEN CASE WHEN {angle} < 0 THEN 'slight-left' ELSE 'slight-right' END
    WHEN {angle} < 0 THEN 'left' ELSE 'right' END"""


TEXT_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in ins.TEXTS.items()) + " END"
PATH_TYPE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PATH_TYPES.items()) + " END"
INSTRUCTIONS_SQL = f"""laid AS (SELECT user_id AS route_id, event_id, {PATH_TYPE_SQL} AS path_type, x, y, CAST(ts AS DATE) AS day, row_number() OVER w AS ord,
  lead(event_id) OVER w AS next_id, lead(x) OVER w - x AS ax, lead(y) OVER w - y AS ay, CAST(lead(ts) OVER w AS DATE) AS next_day, lead(event_type) OVER w AS next_type
  FROM marks WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
steps AS (SELECT *, lead(ord) OVER w IS NULL AS is_last, lag(path_type) OVER w AS prev_path, CAST(abs(ax) + abs(ay) AS DOUBLE) AS cost,
  CASE WHEN path_type = 'stairs' THEN [] WHEN ay <> 0 THEN [0, ay] WHEN ax <> 0 THEN [ax, 0] END AS mark,
  CASE WHEN ax <> 0 THEN [ax, 0] WHEN ay <> 0 THEN [0, ay] END AS head FROM laid WHERE next_id IS NOT NULL WINDOW w AS (PARTITION BY route_id ORDER BY ord)),
faced AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inc FROM steps),
aimed AS (SELECT *, CASE WHEN len(inc) = 2 AND head IS NOT NULL THEN {_turn_sql('inc[1]', 'inc[2]', 'head[1]', 'head[2]')} ELSE 'continue' END AS dir FROM faced),
told AS (SELECT *, is_last AND path_type = 'door' AND next_type = 'purchase' AND dir <> 'continue' AS beside FROM aimed),
spoken AS (
  SELECT route_id, ord, 0 AS sub, path_type AS type, event_id AS node, cost AS distance, CASE WHEN day <> next_day THEN CAST(next_day AS VARCHAR) END AS floor FROM told WHERE path_type = 'stairs'
  UNION ALL SELECT route_id, ord, 0, CASE WHEN contains(dir, 'left') THEN 'destination-left' ELSE 'destination-right' END, next_id, cost, NULL FROM told WHERE path_type <> 'stairs' AND beside
  UNION ALL SELECT route_id, ord, 0, dir, event_id, cost, NULL FROM told WHERE path_type <> 'stairs' AND NOT beside AND ord > 1
  UNION ALL SELECT route_id, ord, 1, 'enter-corridor', event_id, NULL, NULL FROM told WHERE path_type = 'corridor' AND NOT beside AND prev_path IN ('door', 'entrance')
  UNION ALL SELECT route_id, ord, 2, CASE WHEN ax * ay > 0 THEN 'right' ELSE 'left' END, event_id, NULL, NULL FROM told WHERE path_type <> 'stairs' AND ax <> 0 AND ay <> 0
  UNION ALL SELECT route_id, 0, 0, 'start', arg_min(event_id, ord), arg_min(cost, ord), NULL FROM told GROUP BY route_id
  UNION ALL SELECT route_id, max(ord) + 1, 0, 'arrival', arg_max(next_id, ord), 0, NULL FROM told GROUP BY route_id),
flagged AS (SELECT *, CASE WHEN type = 'continue' AND lag(type) OVER (PARTITION BY route_id ORDER BY ord, sub) = 'continue' THEN 0 ELSE 1 END AS s FROM spoken),
isles AS (SELECT *, sum(s) OVER (PARTITION BY route_id ORDER BY ord, sub ROWS UNBOUNDED PRECEDING) AS isle FROM flagged),
folded AS (SELECT route_id, min(ord) AS ord, arg_min(sub, (ord, sub)) AS sub, any_value(type) AS type, arg_min(node, (ord, sub)) AS node, any_value(floor) AS floor,
  CASE WHEN count(*) = 1 THEN max(distance) ELSE sum(coalesce(distance, 0)) END AS distance FROM isles GROUP BY route_id, isle)"""


@query(
    "win_instructions",
    b.with_sql(
        b.EVENTS_SQL,
        INSTRUCTIONS_SQL,
        body=f"""SELECT route_id, ord, sub, type, CAST(node AS VARCHAR) AS node, distance, CASE WHEN floor IS NULL THEN {TEXT_SQL}
  ELSE replace({TEXT_SQL}, '.', '') || ' to floor ' || floor || '.' END AS text_en FROM folded""",
    ),
)
def instructions(t):
    steps = cut(track_steps(t))
    routes = steps.groupBy("route_id").agg(F.min_by("from_node", "ord").alias("start_node"))
    return ins.instructions(steps, routes).select("route_id", "ord", "sub", "type", "node", "distance", "text_en")


@query(
    "prj_instruction_text",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Turn left.' WHEN 'view' THEN 'Turn right.' WHEN 'signup' THEN 'You have arrived at your destination.'
  WHEN 'error' THEN 'Take the stairs' || CASE WHEN value > 50 THEN ' to floor ' || user_id || '.' ELSE '.' END
  ELSE 'Take the elevator' || CASE WHEN value > 50 THEN ' to floor ' || user_id || '.' ELSE '.' END END AS text_en FROM events""",
)
def instruction_text(t):
    kinds = {"click": "left", "view": "right", "signup": "arrival", "error": "stairs", "purchase": "elevator"}
    kind = F.lit(None).cast("string")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    lifted = F.col("event_type").isin("error", "purchase") & (F.col("value") > 50)
    rows = t.events.select("event_id", kind.alias("type"), F.when(lifted, F.col("user_id").cast("string")).alias("floor"))
    return ins.render_text(rows).select("event_id", "text_en")
