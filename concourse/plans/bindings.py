"""Logical tables of the model derived from the driver tables, with the same derivation as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions.geometry import point


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------- directory

PLACES_SQL = """places AS (
  SELECT p_partkey AS place_id, p_brand || '-' || p_partkey AS code, p_name AS name_en,
         split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS name_alt, p_brand AS alias,
         p_brand AS building_id, 'F' || (p_size // 10) AS floor_id, p_type AS category,
         p_size <= 40 AS is_public, p_size > 45 AS is_partial,
         CASE WHEN p_size > 5 THEN 'D' || p_partkey END AS door_node
  FROM part)"""


def places(t) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select(
        F.col("p_partkey").alias("place_id"),
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("code"),
        F.col("p_name").alias("name_en"),
        F.concat_ws(" ", words[1], words[0]).alias("name_alt"),
        F.col("p_brand").alias("alias"),
        F.col("p_brand").alias("building_id"),
        F.concat(F.lit("F"), F.floor(F.col("p_size") / 10).cast("string")).alias("floor_id"),
        F.col("p_type").alias("category"),
        (F.col("p_size") <= 40).alias("is_public"),
        (F.col("p_size") > 45).alias("is_partial"),
        F.when(F.col("p_size") > 5, F.concat(F.lit("D"), F.col("p_partkey").cast("string"))).alias("door_node"),
    )


OVERRIDES_SQL = """overrides AS (
  SELECT doc_id AS place_id, CASE WHEN toxic = 1 THEN 'unavailable' ELSE 'available' END AS status,
         CASE WHEN toxic = 1 THEN 'Closed' ELSE 'Open' END AS reason_en FROM labels)"""


def overrides(t) -> DataFrame:
    closed = F.col("toxic") == 1
    return t.labels.select(
        F.col("doc_id").alias("place_id"),
        F.when(closed, "unavailable").otherwise("available").alias("status"),
        F.when(closed, "Closed").otherwise("Open").alias("reason_en"),
    )


# ---------------------------------------------------------------- tracks and drawing paths from events

EVENTS_SQL = """marks AS (
  SELECT event_id, user_id, event_type, ts, CAST(floor(value * 10) AS BIGINT) AS x,
         10 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS y FROM events)"""


def marks(t) -> DataFrame:
    """Events as positions: value and the ``k`` property give whole-number coordinates."""
    return t.events.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.floor(F.col("value") * 10).cast("long").alias("x"),
        (F.get_json_object("props", "$.k").cast("long") * 10).alias("y"),
    )


PATHS_SQL = (
    EVENTS_SQL
    + """, paths AS (
  SELECT event_id AS path_id, user_id AS source_id, event_type AS layer, x AS x0, y AS y0,
         x + 10 + y // 10 AS x1, y + 40 AS y1 FROM marks)"""
)


def paths(t) -> DataFrame:
    """Drawing paths: one per event, its layer the event type, its box grown from the position."""
    return marks(t).select(
        F.col("event_id").alias("path_id"),
        F.col("user_id").alias("source_id"),
        F.col("event_type").alias("layer"),
        F.col("x").alias("x0"),
        F.col("y").alias("y0"),
        (F.col("x") + 10 + (F.col("y") / 10).cast("long")).alias("x1"),
        (F.col("y") + 40).alias("y1"),
    )


def day_chunk() -> Column:
    """Chunk of a track ordered by (ts, event_id)."""
    return F.date_trunc("day", F.col("ts"))


# ---------------------------------------------------------------- geometry from embeddings


def dim_sql(i: int, scale: int) -> str:
    return f"CAST(round({scale} * CAST(embedding[{i + 1}] AS DOUBLE)) AS BIGINT)"


def dim(i: int, scale: int) -> Column:
    return F.round(F.lit(scale) * F.col("embedding")[i].cast("double")).cast("long")


POINTS_SQL = f"""points AS (
  SELECT vec_id AS point_id, label, {dim_sql(0, 1000)} AS x, {dim_sql(1, 1000)} AS y FROM embeddings)"""


def points(t) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("point_id"), "label", dim(0, 1000).alias("x"), dim(1, 1000).alias("y")
    )


SPANS_SQL = f"""routes AS (
  SELECT vec_id AS route_id, label, {dim_sql(4, 1000)} AS ax, {dim_sql(5, 1000)} AS ay,
         {dim_sql(4, 1000)} + {dim_sql(6, 200)} AS bx, {dim_sql(5, 1000)} + {dim_sql(7, 200)} AS by_ FROM embeddings),
walls AS (
  SELECT vec_id AS wall_id, label AS wall_label, {dim_sql(0, 1000)} AS cx, {dim_sql(1, 1000)} AS cy,
         {dim_sql(0, 1000)} + {dim_sql(2, 200)} AS dx, {dim_sql(1, 1000)} + {dim_sql(3, 200)} AS dy FROM embeddings)"""


def route_segments(t) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("route_id"),
        "label",
        dim(4, 1000).alias("ax"),
        dim(5, 1000).alias("ay"),
        (dim(4, 1000) + dim(6, 200)).alias("bx"),
        (dim(5, 1000) + dim(7, 200)).alias("by_"),
    )


def walls(t) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("wall_id"),
        F.col("label").alias("wall_label"),
        dim(0, 1000).alias("cx"),
        dim(1, 1000).alias("cy"),
        (dim(0, 1000) + dim(2, 200)).alias("dx"),
        (dim(1, 1000) + dim(3, 200)).alias("dy"),
    )


# Diamond outline per label: its leftmost, lowest-y, rightmost and highest-y points in that order.
ZONES_SQL = (
    POINTS_SQL
    + """, zone_ring AS (
  SELECT label AS zone_id, min((x, y)) AS w, min((y, x)) AS n, max((x, y)) AS e, max((y, x)) AS s
  FROM points GROUP BY label),
zone_vertices AS (
  SELECT zone_id, 0 AS ord, w[1] AS x, w[2] AS y FROM zone_ring UNION ALL
  SELECT zone_id, 1, n[2], n[1] FROM zone_ring UNION ALL
  SELECT zone_id, 2, e[1], e[2] FROM zone_ring UNION ALL
  SELECT zone_id, 3, s[2], s[1] FROM zone_ring),
zone_sides AS (
  SELECT a.zone_id, a.ord, a.x AS cx, a.y AS cy, b.x AS dx, b.y AS dy
  FROM zone_vertices a JOIN zone_vertices b ON a.zone_id = b.zone_id AND b.ord = (a.ord + 1) % 4)"""
)


def zones(t) -> DataFrame:
    """Zone outlines with their boxes; extreme points come from combining aggregates."""
    xy, yx = F.struct("x", "y"), F.struct("y", "x")
    extremes = points(t).groupBy(F.col("label").alias("zone_id")).agg(
        F.min(xy).alias("w"), F.min(yx).alias("n"), F.max(xy).alias("e"), F.max(yx).alias("s")
    )
    ring = F.array(*[point(F.col(c)["x"], F.col(c)["y"]) for c in ("w", "n", "e", "s")])
    return extremes.select(
        "zone_id",
        ring.alias("ring"),
        F.col("w.x").cast("double").alias("min_x"),
        F.col("n.y").cast("double").alias("min_y"),
        F.col("e.x").cast("double").alias("max_x"),
        F.col("s.y").cast("double").alias("max_y"),
    )


# ---------------------------------------------------------------- network

NETWORK_SQL = """supplied AS (
  SELECT l_suppkey, l_partkey, l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q
  FROM lineitem GROUP BY ALL),
nav_edges AS (
  SELECT 'L' || l_suppkey || p_brand || l_returnflag || l_linestatus AS edge_id, 'S' || l_suppkey AS from_node, p_brand AS to_node,
         CAST(1 + sum(q) % 97 AS BIGINT) AS cost, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'candidate' ELSE 'unknown' END AS status,
         CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'closed' END AS restriction,
         CASE WHEN sum(n) >= 3 THEN 'confirmed' ELSE 'unknown' END AS accessibility,
         'corridor' AS path_type, l_returnflag <> 'N' AS bidirectional
  FROM supplied JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand, l_returnflag, l_linestatus
  UNION ALL
  SELECT 'D' || s_suppkey, 'S' || s_suppkey, 'N' || s_nationkey, 1 + CAST(floor(abs(s_acctbal) / 100) AS BIGINT),
         'confirmed', 'open', 'confirmed', 'door', true FROM supplier
  UNION ALL
  SELECT 'E' || n_nationkey, 'N' || n_nationkey, 'R' || n_regionkey, 100 + n_nationkey, 'confirmed', 'open', 'confirmed', 'stairs', true
  FROM nation),
nav_nodes AS (
  SELECT 'S' || s_suppkey AS node_id, CASE WHEN s_acctbal < 0 THEN 'candidate' ELSE 'confirmed' END AS status FROM supplier
  UNION ALL SELECT DISTINCT p_brand, 'confirmed' FROM part
  UNION ALL SELECT 'N' || n_nationkey, 'confirmed' FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'confirmed' FROM region),
directed AS (
  SELECT edge_id, from_node AS src, to_node AS dst, cost FROM nav_edges
  WHERE status IN ('confirmed', 'candidate') AND restriction IN ('open', 'unknown')
  UNION ALL
  SELECT edge_id, to_node, from_node, cost FROM nav_edges
  WHERE status IN ('confirmed', 'candidate') AND restriction IN ('open', 'unknown') AND bidirectional)"""


def nav_edges(t) -> DataFrame:
    """Parallel supplier-brand links by evidence and restriction, supplier-nation doors, nation-region stairs.

    Line items are dealt by part before they combine: pairs of supplier and part hardly repeat, so a combining scan would
    hold nearly every row of its split.  ``part`` is the side in memory, and Spark splits the rows of a hot part.
    """
    items = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    brands = t.part.select("p_partkey", "p_brand").hint("shuffle_hash")
    links = (
        items.join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_brand", "l_returnflag", "l_linestatus")
        .agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n"))
    )
    key = F.col("l_suppkey").cast("string")
    links = links.select(
        F.concat(F.lit("L"), key, "p_brand", "l_returnflag", "l_linestatus").alias("edge_id"),
        F.concat(F.lit("S"), key).alias("from_node"),
        F.col("p_brand").alias("to_node"),
        (1 + F.col("q") % 97).cast("long").alias("cost"),
        F.when(F.col("l_returnflag") == "A", "confirmed")
        .when(F.col("l_returnflag") == "N", "candidate")
        .otherwise("unknown")
        .alias("status"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("restriction"),
        F.when(F.col("n") >= 3, "confirmed").otherwise("unknown").alias("accessibility"),
        F.lit("corridor").alias("path_type"),
        (F.col("l_returnflag") != "N").alias("bidirectional"),
    )

    def fixed(df, edge, a, b, cost, path_type):
        return df.select(
            edge.alias("edge_id"),
            a.alias("from_node"),
            b.alias("to_node"),
            cost.cast("long").alias("cost"),
            F.lit("confirmed").alias("status"),
            F.lit("open").alias("restriction"),
            F.lit("confirmed").alias("accessibility"),
            F.lit(path_type).alias("path_type"),
            F.lit(True).alias("bidirectional"),
        )

    def tag(letter, c):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    doors = fixed(
        t.supplier,
        tag("D", "s_suppkey"),
        tag("S", "s_suppkey"),
        tag("N", "s_nationkey"),
        1 + F.floor(F.abs("s_acctbal") / 100),
        "door",
    )
    stairs = fixed(
        t.nation,
        tag("E", "n_nationkey"),
        tag("N", "n_nationkey"),
        tag("R", "n_regionkey"),
        100 + F.col("n_nationkey"),
        "stairs",
    )
    return links.unionByName(doors).unionByName(stairs)


def nav_nodes(t) -> DataFrame:
    ok = F.lit("confirmed").alias("status")
    suppliers = t.supplier.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node_id"),
        F.when(F.col("s_acctbal") < 0, "candidate").otherwise("confirmed").alias("status"),
    )
    brands = t.part.select(F.col("p_brand").alias("node_id")).distinct().select("node_id", ok)
    nations = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"), ok)
    regions = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node_id"), ok)
    return suppliers.unionByName(brands).unionByName(nations).unionByName(regions)


# ---------------------------------------------------------------- domains: a box with a hole in its middle third


def holed_sql(source: str, key: str) -> str:
    """Frames (x0..y1) of the positions per key, and their holes (hx0..hy1)."""
    return f"""frames AS (SELECT {key} AS domain_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {source} GROUP BY {key}),
boxes AS (SELECT *, x0 + (x1 - x0) // 3 AS hx0, y0 + (y1 - y0) // 3 AS hy0, x1 - (x1 - x0) // 3 AS hx1, y1 - (y1 - y0) // 3 AS hy1 FROM frames)"""


def through_sql(ax: str, ay: str, bx: str, by: str) -> str:
    """The segment passes through the inside of the hole."""

    def span(a: str, z: str, low: str, high: str, of: str) -> tuple[str, str]:
        inside = f"{a} > {low} AND {a} < {high}"
        ends = f"(({low} - {a})::DOUBLE / nullif({z} - {a}, 0)), (({high} - {a})::DOUBLE / nullif({z} - {a}, 0))"
        return (
            f"CASE WHEN {a} = {z} THEN CASE WHEN {inside} THEN 0 ELSE 2 END ELSE least({ends}) END",
            f"CASE WHEN {a} = {z} THEN CASE WHEN {inside} THEN 1 ELSE -1 END ELSE greatest({ends}) END",
        )

    (xl, xh), (yl, yh) = span(ax, bx, "hx0", "hx1", "x"), span(ay, by, "hy0", "hy1", "y")
    return f"(greatest(0, {xl}, {yl}) + 1e-9 < least(1, {xh}, {yh}))"


def holed_domains(positions: DataFrame, key: str) -> DataFrame:
    """Rings of the domains: the box of the positions per key, and the hole in it."""
    low_high = {f"{c}{i}": fn(c) for c in ("x", "y") for i, fn in ((0, F.min), (1, F.max))}
    box = positions.groupBy(F.col(key).alias("domain_id")).agg(*[v.alias(k) for k, v in low_high.items()])
    third = {c: F.floor((F.col(f"{c}1") - F.col(f"{c}0")) / 3) for c in ("x", "y")}
    outer = [F.col(f"{c}{i}") for i in (0, 1) for c in ("x", "y")]
    hole = [F.col(f"{c}0") + third[c] for c in ("x", "y")] + [F.col(f"{c}1") - third[c] for c in ("x", "y")]

    def ring(b: list[Column]) -> Column:
        b = [c.cast("double") for c in b]
        corners = [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
        points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
        return F.struct(points.alias("ring"), b[0].alias("min_x"), b[1].alias("min_y"), b[2].alias("max_x"), b[3].alias("max_y"))

    return box.select("domain_id", F.explode(F.array(ring(outer), ring(hole))).alias("r")).select("domain_id", "r.*")
