"""Linear referencing along the event tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import linear as ln
from concourse.operators.measures import arc_length
from concourse.plans import bindings as b
from concourse.plans.aggregates import STEPS_SQL, TRACK, track
from concourse.plans.registry import query

MEASURED_SQL = """runs AS (SELECT user_id, ts, event_id, x, y, nx, ny, coalesce(seg, 0) AS seg,
  sum(coalesce(seg, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m1,
  sum(coalesce(seg, 0)) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM segs),
asked AS (SELECT event_id AS request_id, user_id, greatest(0.0, least(1.0, (event_id % 29 - 3) / 20.0::DOUBLE)) AS t FROM events),
aimed AS (SELECT request_id, r.*, t, total * t AS target, m1 - seg AS m0 FROM asked JOIN runs r USING (user_id))"""


def _progress(t):
    """Every event asks for a place on its own track; fractions below 0 and above 1 clamp."""
    return t.events.select(F.col("event_id").alias("request_id"), "user_id", ((F.col("event_id") % 29 - 3) / 20).alias("t"))


@query(
    "lrs_point_at",
    b.with_sql(
        STEPS_SQL,
        MEASURED_SQL,
        """picked AS (SELECT request_id, user_id, arg_min(x + (nx - x) * (target - m0) / nullif(seg, 0), n) FILTER (WHERE seg > 0 AND target <= m1) AS hx,
  arg_min(y + (ny - y) * (target - m0) / nullif(seg, 0), n) FILTER (WHERE seg > 0 AND target <= m1) AS hy, arg_max(x, n) AS lx, arg_max(y, n) AS ly FROM aimed GROUP BY ALL)""",
        body="SELECT request_id, user_id, round(coalesce(hx, lx), 2) AS x, round(coalesce(hy, ly), 2) AS y FROM picked",
    ),
)
def point_at(t):
    out = ln.point_at(track(t), _progress(t), "user_id", TRACK, b.day_chunk())
    return out.select("request_id", "user_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(
    "lrs_clip_prefix",
    b.with_sql(
        STEPS_SQL,
        MEASURED_SQL,
        """shown AS (SELECT request_id, x, y FROM aimed WHERE t >= 1 OR n = 1
  UNION ALL SELECT request_id, nx, ny FROM aimed WHERE t < 1 AND seg > 0 AND target >= m1
  UNION ALL SELECT request_id, x + (nx - x) * (target - m0) / seg, y + (ny - y) * (target - m0) / seg FROM aimed WHERE t < 1 AND seg > 0 AND target > m0 AND target < m1)""",
        body="SELECT request_id, count(*) AS points, round(sum(x), 1) AS sum_x, round(sum(y), 1) AS sum_y FROM shown GROUP BY request_id",
    ),
)
def clip_prefix(t):
    out = ln.clip_track(track(t), _progress(t), "user_id", TRACK, b.day_chunk())
    return out.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("x"), 1).alias("sum_x"), F.round(F.sum("y"), 1).alias("sum_y")
    )


@query(
    "lrs_duration",
    b.with_sql(
        STEPS_SQL,
        body="SELECT user_id, round(least(60000, greatest(900, coalesce(sum(seg), 0) / 2.5)), 2) AS duration_ms FROM segs GROUP BY user_id",
    ),
)
def duration(t):
    lengths = arc_length(track(t), "user_id", TRACK, b.day_chunk())
    timed = ln.traverse_ms(lengths, 2.5, None, 60000.0)
    return timed.select("user_id", F.round("duration_ms", 2).alias("duration_ms"))


@query(
    "sc_clamp_index",
    "SELECT l_orderkey, l_partkey, l_linenumber, least(l_linenumber - 1, greatest(0, CAST(floor(l_quantity / 5 - 2) AS BIGINT))) AS idx FROM lineitem",
)
def clamp_index(t):
    idx = ln.clamp_index(F.col("l_quantity") / 5 - 2, F.col("l_linenumber").cast("double"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", idx.alias("idx"))
