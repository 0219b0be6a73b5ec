"""Reconciliation reports over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import drawings as dw
from concourse.operators import network as nw
from concourse.operators import reports as rp
from concourse.operators import spatial as sp
from concourse.plans import aggregates as ag
from concourse.plans import bindings as b
from concourse.plans import network as net
from concourse.plans import ordering as od
from concourse.plans import scans as sc
from concourse.plans import spatial_joins as sj
from concourse.plans.registry import REGISTRY, query
from concourse.session import cut


def _sql(key: str) -> str:
    return REGISTRY[key].sql


@query(
    "agg_network_report",
    f"""WITH RECURSIVE {b.NETWORK_SQL}, {b.SPANS_SQL},
links AS (SELECT from_node AS a, to_node AS z FROM nav_edges UNION SELECT to_node, from_node FROM nav_edges),
seen AS (SELECT 'R0' AS node UNION SELECT z FROM seen JOIN links ON node = a),
base AS (SELECT (SELECT count(*) FROM nav_nodes) AS nodes, (SELECT count(*) FROM nav_edges) AS edges, (SELECT count(*) FROM embeddings) AS areas, (SELECT count(*) FROM walls) AS walls,
  (SELECT count(*) FROM seen WHERE node LIKE 'S%') AS reached_places, (SELECT count(*) FROM ({_sql('join_segment_intersect')})) AS wall_contacts,
  (SELECT count(*) FROM ({_sql('join_cover_union')})) AS area_failures, (SELECT count(*) FROM ({_sql('join_interior_crossing')})) AS interior_crossings)
SELECT *, CASE WHEN nodes = (SELECT count(*) FROM seen) THEN reached_places * (reached_places - 1) END AS ordered_pairs FROM base""",
)
def network_report(t):
    reached = cut(net.reachability(t))
    return rp.network_report(
        b.nav_nodes(t), b.nav_edges(t), t.embeddings, b.walls(t), reached, reached.filter("node like 'S%'"), sj.segment_intersect(t), sj.cover_union(t), sj.interior_crossing(t)
    )


@query(
    "rep_ingest_validation",
    f"""WITH parts AS (SELECT (SELECT count(*) FROM ({_sql('src_regeneration_diff')})) AS changed_files, (SELECT count(*) FROM ({_sql('flt_layer_allowlist')})) AS kept_paths,
  (SELECT count(*) FROM ({_sql('set_signature_intersect')})) AS overlap, (SELECT max(l_discount / 4) FROM lineitem) AS max_residual,
  (SELECT count(*) FROM conversations WHERE role = 'user') AS schedule_rows)
SELECT *, changed_files = 0 AS hashes_match FROM parts""",
)
def ingest_validation(t):
    anchors = t.lineitem.select((F.col("l_discount") / 4).alias("residual"))
    kept = dw.keep_paths(b.paths(t), ["click", "view", "error"], (100, 200, 300, 700))
    return rp.ingest_validation(sc.regeneration_diff(t), kept, od.signature_intersect(t), anchors, t.conversations.filter("role = 'user'"))


STATUS_SQL = "CASE WHEN p_size > 40 THEN 'unknown' WHEN p_type = 'PROMO' THEN 'confirmed' ELSE 'candidate' END"


def _inventory(t):
    status = F.when(F.col("p_size") > 40, "unknown").when(F.col("p_type") == "PROMO", "confirmed").otherwise("candidate")
    return t.part.select(
        F.col("p_partkey").alias("place_id"),
        F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("code"),
        F.col("p_name").alias("name_en"),
        status.alias("geometry_status"),
        F.when(F.col("p_size") <= 42, F.col("p_retailprice")).alias("area"),
    )


@query(
    "rep_semantic_verify",
    f"""SELECT count(*) AS inventory, count(DISTINCT p_partkey) AS unique_ids, count(*) FILTER (WHERE {STATUS_SQL} <> 'unknown') AS valid_outlines,
  count(*) FILTER (WHERE {STATUS_SQL} = 'unknown') AS unresolved_outlines FROM part""",
)
def semantic_verify(t):
    return rp.semantic_verify(_inventory(t))


TRUTH_SQL = f"""SELECT 'every id is present' AS label, 0 AS failed_rows UNION ALL SELECT 'every name is filled', 0
UNION ALL SELECT 'codes are unique', (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_brand, p_size HAVING count(*) > 1))
UNION ALL SELECT 'outline matches its evidence', (SELECT count(*) FROM part WHERE ({STATUS_SQL} = 'unknown') <> (p_size > 42))
UNION ALL SELECT 'overrides name known places', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'evidence resolves', (SELECT count(*) FROM ({_sql('join_evidence_trace')}))
UNION ALL SELECT 'coordinates were moved once', (SELECT count(*) FROM ({_sql('join_recompute_compare')}))"""


@query("rep_source_truth", f"SELECT label, failed_rows = 0 AS passed, CAST(failed_rows AS BIGINT) AS failed_rows FROM ({TRUTH_SQL})")
def source_truth(t):
    from concourse.plans import joins

    return rp.source_truth(_inventory(t), b.overrides(t), joins.evidence_trace(t), joins.recompute_compare(t))


# The reported trip, told with and without the way through the root of the tree.
TRIP = ("N1", "N6")
TRIP_SQL = f"FROM ({_sql('gr_detour_via')}) WHERE start_node = '{TRIP[0]}' AND end_node = '{TRIP[1]}'"


@query(
    "rep_topology",
    f"""SELECT pairs, unordered_pairs, max_ratio, failures, (SELECT cycles FROM ({_sql('agg_cycle_rank')})) AS cycles,
  (SELECT count(*) FILTER (WHERE worse) FROM ({_sql('gr_tree_control')})) AS tree_worse, (SELECT direct {TRIP_SQL}) AS trip_direct, (SELECT via_cost {TRIP_SQL}) AS trip_via
FROM ({_sql('agg_cost_ratio')}), (SELECT count(*) AS pairs, count(DISTINCT (least(start_node, end_node), greatest(start_node, end_node))) AS unordered_pairs FROM ({_sql('join_pairs_reference')}))""",
)
def topology(t):
    """Costs against their reference, the negative control of a rooted tree, and one trip against its detour.

    Steps and the full matrix are derived once for all three."""
    steps = ag.shared_steps(t)
    matrix = cut(nw.cost_matrix(steps, net._nations(t)))
    compared = cut(ag.pairs_reference(t, steps, matrix))
    detours = cut(net.tree_control(t, steps.drop("step_free"), matrix))
    trip = net.detour_via(t, matrix).filter((F.col("start_node") == TRIP[0]) & (F.col("end_node") == TRIP[1]))
    return rp.topology(compared, b.nav_nodes(t), b.nav_edges(t), detours, trip)


DOOR_GAP = 2.5


@query(
    "rep_review_rows",
    b.with_sql(
        b.ZONES_SQL,
        b.SPANS_SQL,
        sj.PIP_SQL,
        f"near AS (SELECT DISTINCT zone_id, route_id FROM routes, zone_sides WHERE {sj.GAP_SQL} < {DOOR_GAP})",
        "areas AS (SELECT zone_id, CAST(sum(cx * dy - dx * cy) AS DOUBLE) / 2 AS area FROM zone_sides GROUP BY zone_id)",
        body="""SELECT zone_id AS place_id, round(area, 3) AS area, (SELECT string_agg(point_id, ',' ORDER BY point_id) FROM hits h WHERE h.zone_id = a.zone_id) AS labels,
  (SELECT string_agg(route_id, ',' ORDER BY route_id) FROM near n WHERE n.zone_id = a.zone_id) AS doors, CASE WHEN zone_id = 3 THEN 'tag differs' END AS conflict,
  CASE WHEN area > 100000 THEN 'wide' ELSE 'closed' END AS reason FROM areas a""",
    ),
)
def review_rows(t):
    from concourse.functions.geometry import ring_area

    zones = b.zones(t)
    area = ring_area(F.col("ring"))
    places = zones.select(
        F.col("zone_id").alias("place_id"),
        F.round(area, 3).alias("area"),
        F.when(F.col("zone_id") == 3, "tag differs").alias("conflict"),
        F.when(area > 100000, "wide").otherwise("closed").alias("reason"),
    )
    labels = sj._hits(t).select(F.col("zone_id").alias("place_id"), F.col("point_id").alias("label_id"))
    gaps = sp.within_distance(b.route_segments(t), sp.boundary(zones, "zone_id"), DOOR_GAP, base=sj.BASE)
    doors = gaps.select(F.col("zone_id").alias("place_id"), F.col("route_id").alias("door_id"))
    rows = rp.review_rows(places, labels, doors)
    joined = lambda c: F.array_join(c, ",")
    return rows.select("place_id", "area", joined("label_ids").alias("labels"), joined("door_ids").alias("doors"), "conflict", "reason")


@query(
    "rep_conflicts",
    """SELECT s_suppkey AS number, s_name AS schedule_name, c_name AS plan_name FROM supplier JOIN customer ON c_custkey = s_suppkey
WHERE replace(s_name, 'Supplier', 'Customer') <> c_name OR s_nationkey = c_nationkey""",
)
def conflict_rows(t):
    """Names of equal number agree once the kind is dropped, unless both sit in one nation."""
    number = F.regexp_extract("s_name", "[0-9]+", 0)
    schedule = t.supplier.select(
        F.col("s_suppkey").alias("number"), F.col("s_name").alias("raw"), F.col("s_nationkey"), F.concat(F.lit("customer#"), number).alias("schedule_name")
    )
    labels = t.customer.select(F.col("c_custkey").alias("number"), F.col("c_name"), F.col("c_nationkey"))
    pairs = schedule.join(labels, "number")
    plan = F.when(F.col("s_nationkey") == F.col("c_nationkey"), F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name"))
    keyed = pairs.select("number", plan.alias("plan_name"), F.col("c_name"))
    found = rp.conflicts(schedule.select("number", "raw", "schedule_name"), keyed)
    return found.select("number", F.col("raw").alias("schedule_name"), F.col("c_name").alias("plan_name"))
