"""Reading-order and track windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import sequences as sq
from concourse.operators.linear import cumulative
from concourse.operators.measures import path_segments, ring_segments
from concourse.plans import bindings as b
from concourse.plans.aggregates import STEPS_SQL, TRACK, track, zone_vertices
from concourse.plans.registry import query

SPANS_SQL = "spans AS (SELECT conv_id AS source_id, turn AS ord, role, text FROM conversations)"


def _spans(t):
    return t.conversations.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("ord"), "role", "text")


@query(
    "win_next_span_pair",
    b.with_sql(
        SPANS_SQL,
        "paired AS (SELECT *, lead(text) OVER w AS name, lead(ord) OVER w AS name_ord FROM spans WINDOW w AS (PARTITION BY source_id ORDER BY ord))",
        body="SELECT source_id, ord, name_ord, md5(text) AS code_hash, md5(trim(name)) AS name_hash FROM paired WHERE role = 'user' AND name_ord IS NOT NULL",
    ),
)
def next_span_pair(t):
    rows = sq.schedule_rows(_spans(t), is_code=F.col("role") == "user")
    return rows.select("source_id", "ord", "name_ord", F.md5("text").alias("code_hash"), F.md5("name").alias("name_hash"))


@query(
    "win_label_triplet",
    b.with_sql(
        SPANS_SQL,
        "laid AS (SELECT *, lag(ord, 1) OVER w AS name_ord, lag(ord, 2) OVER w AS tag_ord, lag(role, 2) OVER w AS tag_role FROM spans WINDOW w AS (PARTITION BY source_id ORDER BY ord))",
        body="SELECT source_id, ord, name_ord, tag_ord FROM laid WHERE role = 'user' AND tag_role = 'user'",
    ),
)
def label_triplet(t):
    spans = _spans(t).select("source_id", "ord", F.col("role").alias("text"))
    rows = sq.plan_labels(spans, is_mark=F.col("text") == "user", is_tag="tag_text = 'user'")
    return rows.select("source_id", "ord", "name_ord", "tag_ord")


@query(
    "win_ring_segments",
    b.with_sql(b.ZONES_SQL, body="SELECT zone_id, ord, CAST(cx AS DOUBLE) AS x, CAST(cy AS DOUBLE) AS y, CAST(dx AS DOUBLE) AS nx, CAST(dy AS DOUBLE) AS ny FROM zone_sides"),
)
def ring_segs(t):
    return ring_segments(zone_vertices(t), "zone_id").select("zone_id", "ord", "x", "y", "nx", "ny")


RINGS_SQL = """ring AS (SELECT l_orderkey AS ring_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
  CAST(l_quantity AS BIGINT) // 20 AS x, l_linenumber // 4 AS y FROM lineitem)"""


@query(
    "win_ring_close_dedupe",
    b.with_sql(
        RINGS_SQL,
        """seen AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(ord) OVER w AS nxt, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy
  FROM ring WINDOW w AS (PARTITION BY ring_id ORDER BY ord))""",
        body="""SELECT ring_id, count(*) AS vertices, CAST(sum(ord) AS BIGINT) AS ord_sum FROM seen WHERE NOT coalesce(x = px AND y = py, false)
  AND NOT (nxt IS NULL AND ord <> 1 AND x = fx AND y = fy) GROUP BY ring_id""",
    ),
)
def ring_close_dedupe(t):
    from concourse.operators.ordered import row_numbers

    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    keyed = row_numbers(
        line, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_linenumber"), "ord"
    )
    ring = keyed.select(
        F.col("l_orderkey").alias("ring_id"),
        "ord",
        F.floor(F.col("l_quantity") / 20).alias("x"),
        F.floor(F.col("l_linenumber") / 4).alias("y"),
    )
    clean = sq.clean_ring_rows(ring, "ring_id", 1e-7)
    return clean.groupBy("ring_id").agg(F.count(F.lit(1)).alias("vertices"), F.sum("ord").alias("ord_sum"))


@query(
    "win_join_polylines",
    b.with_sql(
        b.EVENTS_SQL,
        "coarse AS (SELECT user_id, ts, event_id, x // 1000 AS x, y // 500 AS y FROM marks)",
        "seen AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM coarse WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
        body="SELECT user_id, event_id, x, y FROM seen WHERE NOT coalesce(x = px AND y = py, false)",
    ),
)
def join_polylines(t):
    coarse = b.marks(t).select(
        "user_id", "ts", "event_id", F.floor(F.col("x") / 1000).alias("x"), F.floor(F.col("y") / 500).alias("y")
    )
    return sq.join_polylines(coarse, "user_id", TRACK, b.day_chunk()).select("user_id", "event_id", "x", "y")


TURNS_SQL = """moves AS (SELECT user_id, ts, event_id, nx - x AS dx, ny - y AS dy FROM segs WHERE seg > 0),
turned AS (SELECT *, lag(dx) OVER w AS pdx, lag(dy) OVER w AS pdy FROM moves WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
angled AS (SELECT *, degrees(atan2((pdx * dy - pdy * dx)::DOUBLE, (pdx * dx + pdy * dy)::DOUBLE)) AS angle FROM turned WHERE pdx IS NOT NULL),
named AS (SELECT *, CASE WHEN abs(angle) < 15 - 1e-7 THEN 'continue' WHEN abs(angle) < 45 - 1e-7 THEN CASE WHEN angle < 0 THEN 'slight-left' ELSE 'slight-right' END
  WHEN angle < 0 THEN 'left' ELSE 'right' END AS turn FROM angled)"""


def _turns(t):
    seg = path_segments(track(t), "user_id", TRACK, b.day_chunk())
    moves = seg.select("user_id", "ts", "event_id", (F.col("nx") - F.col("x")).alias("dx"), (F.col("ny") - F.col("y")).alias("dy"))
    return sq.turns(moves.filter("dx <> 0 or dy <> 0"), "user_id", TRACK, b.day_chunk())


@query(
    "win_turn_angle",
    b.with_sql(STEPS_SQL, TURNS_SQL, body="SELECT user_id, event_id, round(angle, 5) AS angle, turn FROM named"),
)
def turn_angle(t):
    return _turns(t).select("user_id", "event_id", F.round("angle", 5).alias("angle"), "turn")


@query(
    "win_merge_continue",
    b.with_sql(
        STEPS_SQL,
        TURNS_SQL,
        """typed AS (SELECT user_id, ts, event_id, CASE WHEN turn LIKE 'slight%' THEN 'continue' ELSE turn END AS type, CASE WHEN dx > 0 THEN CAST(dx AS DOUBLE) END AS distance FROM named),
flagged AS (SELECT *, CASE WHEN type = 'continue' AND coalesce(lag(type) OVER w = 'continue', false) THEN 0 ELSE 1 END AS s FROM typed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
isles AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isle FROM flagged)""",
        body="""SELECT user_id, min(event_id) AS event_id, any_value(type) AS type, CASE WHEN count(*) = 1 THEN max(distance) ELSE sum(coalesce(distance, 0)) END AS distance
FROM isles GROUP BY user_id, isle""",
    ),
)
def merge_continue(t):
    kind = F.when(F.col("turn").startswith("slight"), "continue").otherwise(F.col("turn"))
    rows = _turns(t).select("user_id", "ts", "event_id", kind.alias("type"), F.when(F.col("dx") > 0, F.col("dx")).alias("distance"))
    folded = sq.fold_continue(rows, "user_id", TRACK, b.day_chunk())
    return folded.select("user_id", "event_id", "type", "distance")


@query(
    "win_cut_intervals",
    """WITH cuts AS (SELECT DISTINCT l_orderkey AS segment_id, l_quantity / 64 AS t FROM lineitem),
paired AS (SELECT segment_id, t AS t0, lead(t) OVER (PARTITION BY segment_id ORDER BY t) AS t1 FROM cuts)
SELECT segment_id, t0, t1 FROM paired WHERE t1 IS NOT NULL""",
)
def cut_intervals(t):
    cuts = t.lineitem.select(F.col("l_orderkey").alias("segment_id"), (F.col("l_quantity") / 64).alias("t"))
    return sq.intervals(cuts, "segment_id")


@query(
    "win_cumulative_arc",
    b.with_sql(
        STEPS_SQL,
        body="""SELECT user_id, event_id, round(coalesce(sum(seg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS measure FROM segs""",
    ),
)
def cumulative_arc(t):
    out = cumulative(track(t), "user_id", TRACK, b.day_chunk())
    return out.select("user_id", "event_id", F.round("measure", 3).alias("measure"))
