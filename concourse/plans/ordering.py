"""Sorts, minima and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import directory as dr
from concourse.operators import relational as rl
from concourse.plans import bindings as b
from concourse.plans.registry import query


@query(
    "top_lexicographic_min",
    """SELECT l_orderkey, (m)[1] AS quantity, (m)[2] AS price, (m)[3] AS l_partkey FROM
  (SELECT l_orderkey, min((l_quantity, l_extendedprice, l_partkey)) AS m FROM lineitem GROUP BY l_orderkey)""",
)
def lexicographic_min(t):
    best = t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_quantity", "l_extendedprice", "l_partkey")).alias("m"))
    return best.select(
        "l_orderkey", F.col("m.l_quantity").alias("quantity"), F.col("m.l_extendedprice").alias("price"), F.col("m.l_partkey").alias("l_partkey")
    )


@query("top_selected_first", b.with_sql(b.PLACES_SQL, body="SELECT place_id, code, place_id = 17 AS selected FROM places"))
def selected_first(t):
    rows = b.places(t).select("place_id", "code", (F.col("place_id") == 17).alias("selected"))
    return dr.selected_first(rows, F.col("selected"), "place_id")


@query(
    "top_canonical_sort",
    """SELECT DISTINCT '{"x":' || CAST(l_quantity AS BIGINT) || ',"y":' || l_linenumber || '}' AS record FROM lineitem""",
)
def canonical_sort(t):
    from concourse.sources.sinks import canonical_rows

    rows = t.lineitem.select(F.col("l_quantity").cast("long").alias("x"), F.col("l_linenumber").alias("y"))
    return canonical_rows(rows).select("record")


@query(
    "set_signature_intersect",
    """WITH s AS (SELECT l_returnflag, l_linenumber || '/' || CAST(l_quantity AS BIGINT) || '/' || CAST(round(l_extendedprice / 100) AS BIGINT) AS signature FROM lineitem)
SELECT signature FROM s WHERE l_returnflag = 'A' INTERSECT SELECT signature FROM s WHERE l_returnflag <> 'A'""",
)
def signature_intersect(t):
    sig = F.concat_ws(
        "/",
        F.col("l_linenumber").cast("string"),
        F.col("l_quantity").cast("long").cast("string"),
        F.round(F.col("l_extendedprice") / 100).cast("long").cast("string"),
    )
    rows = t.lineitem.select("l_returnflag", sig.alias("signature"))
    return rl.signature_overlap(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag <> 'A'"))


@query(
    "set_code_symmetric_diff",
    """SELECT code, 'left' AS side FROM (SELECT doc_id AS code FROM documents EXCEPT ALL SELECT doc_id FROM labels)
UNION ALL SELECT code, 'right' FROM (SELECT doc_id AS code FROM labels EXCEPT ALL SELECT doc_id FROM documents)""",
)
def code_symmetric_diff(t):
    code = F.col("doc_id").alias("code")
    return rl.symmetric_diff(t.documents.select(code), t.labels.select(code))


@query(
    "set_union_used_edges",
    "SELECT DISTINCT least(o_custkey, l_suppkey) AS low_node, greatest(o_custkey, l_suppkey) AS high_node FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def union_used_edges(t):
    walked = t.lineitem.select("l_orderkey", "l_suppkey").join(
        t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return rl.used_edges(walked.select(F.col("o_custkey").alias("from_node"), F.col("l_suppkey").alias("to_node")))
