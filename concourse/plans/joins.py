"""Equi-joins and lookups: content, references, availability, origins, translations, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import directory as dr
from concourse.operators import relational as rl
from concourse.operators.ordered import first_per
from concourse.plans import bindings as b
from concourse.plans.filters import CONTENT_SQL, DEFAULT_TEXT, _content
from concourse.plans.registry import query


@query(
    "join_content",
    b.with_sql(
        b.PLACES_SQL,
        CONTENT_SQL,
        body=f"""SELECT place_id, md5(CASE WHEN length(description) > 0 THEN description ELSE '{DEFAULT_TEXT}' END) AS description_hash,
  content_ref IS NULL AS defaulted FROM places LEFT JOIN content ON place_id = content_ref""",
    ),
)
def join_content(t):
    content = _content(t).withColumn("found", F.lit(True))
    rows = dr.with_content(b.places(t).withColumn("content_ref", F.col("place_id")), content, DEFAULT_TEXT)
    return rows.select("place_id", F.md5("description").alias("description_hash"), F.col("found").isNull().alias("defaulted"))


@query(
    "join_missing_ref",
    """SELECT o_orderkey AS order_id, o_custkey AS missing_part FROM orders WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = o_custkey)""",
)
def missing_ref(t):
    bad = rl.fk_violations(t.orders.select("o_orderkey", "o_custkey"), t.labels, [("o_custkey", "doc_id")])
    return bad.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("missing_part"))


@query("join_orphan", "SELECT doc_id AS content_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan(t):
    content = t.documents.select(F.col("doc_id").alias("content_id"))
    return rl.orphans(content, t.labels, "content_id", "doc_id")


@query(
    "join_reciprocal",
    """SELECT c_custkey AS place_id, s_suppkey AS node_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
WHERE c_acctbal > 0 AND NOT coalesce(s_nationkey = c_nationkey AND s_acctbal > 0, false)""",
)
def reciprocal(t):
    places = t.customer.select(
        F.col("c_custkey").alias("place_id"),
        F.col("c_nationkey").alias("floor_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("door_node"),
    )
    nodes = t.supplier.select(
        F.col("s_suppkey").alias("node_id"),
        F.col("s_suppkey").alias("room_id"),
        F.col("s_nationkey").alias("node_floor"),
        F.when(F.col("s_acctbal") > 0, "door").otherwise("junction").alias("node_type"),
    )
    return rl.reciprocal_violations(places, nodes).select("place_id", "node_id")


@query(
    "join_origin_resolution",
    b.with_sql(
        b.PLACES_SQL,
        """kiosks AS (SELECT s_suppkey AS kiosk_id, s_nationkey AS scope_id, 'K' || s_suppkey AS node_id,
  CASE WHEN s_acctbal > 0 THEN 'confirmed' ELSE 'unknown' END AS status FROM supplier),
only_one AS (SELECT scope_id, min(node_id) AS node_id, min(status) AS status FROM kiosks GROUP BY scope_id HAVING count(*) = 1),
requests AS (SELECT c_custkey AS request_id, c_nationkey AS scope_id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END AS kiosk_id,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey END AS custom_place_id, c_nationkey AS default_place_id FROM customer),
resolved AS (SELECT r.request_id, r.custom_place_id IS NOT NULL AS custom, p.door_node AS custom_node, d.door_node AS default_node,
  CASE WHEN r.kiosk_id IS NOT NULL THEN CASE WHEN k.status = 'confirmed' THEN k.node_id END
       ELSE CASE WHEN o.status = 'confirmed' THEN o.node_id END END AS kiosk_node
  FROM requests r LEFT JOIN kiosks k ON k.kiosk_id = r.kiosk_id AND k.scope_id = r.scope_id
  LEFT JOIN only_one o ON o.scope_id = r.scope_id
  LEFT JOIN places p ON p.place_id = r.custom_place_id LEFT JOIN places d ON d.place_id = r.default_place_id)""",
        body="""SELECT request_id, CASE WHEN custom THEN custom_node ELSE coalesce(kiosk_node, default_node) END AS start_node,
  CASE WHEN custom THEN 'custom' WHEN kiosk_node IS NOT NULL THEN 'kiosk' WHEN default_node IS NOT NULL THEN 'default' ELSE 'none' END AS origin
FROM resolved""",
    ),
)
def origin_resolution(t):
    kiosks = t.supplier.select(
        F.col("s_suppkey").alias("kiosk_id"),
        F.col("s_nationkey").alias("scope_id"),
        F.concat(F.lit("K"), F.col("s_suppkey").cast("string")).alias("node_id"),
        F.when(F.col("s_acctbal") > 0, "confirmed").otherwise("unknown").alias("status"),
    )
    segment = F.col("c_mktsegment")
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_nationkey").alias("scope_id"),
        F.when(segment == "BUILDING", F.col("c_custkey")).alias("kiosk_id"),
        F.when(segment == "MACHINERY", F.col("c_custkey")).alias("custom_place_id"),
        F.col("c_nationkey").cast("long").alias("default_place_id"),
    )
    return dr.resolve_origin(requests, kiosks, b.places(t)).select("request_id", "start_node", "origin")


@query(
    "join_availability_overlay",
    b.with_sql(
        b.PLACES_SQL,
        b.OVERRIDES_SQL,
        body="""SELECT place_id, coalesce(status, 'available') AS status, reason_en, coalesce(status, 'available') = 'available' AS can_be_destination
FROM places LEFT JOIN overrides USING (place_id)""",
    ),
)
def availability_overlay(t):
    return dr.overlay(b.places(t).select("place_id"), b.overrides(t)).select(
        "place_id", "status", "reason_en", "can_be_destination"
    )


DICTIONARY_SQL = """dictionary AS (
  SELECT 'en' AS lang, 'part.' || p_partkey AS key, p_name AS text FROM part
  UNION ALL SELECT 'ar', 'part.' || p_partkey, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part WHERE p_size <= 25)"""


def _dictionary(t):
    places = b.places(t).join(t.part.select("p_partkey", "p_size"), F.col("place_id") == F.col("p_partkey"))
    key = F.concat(F.lit("part."), F.col("p_partkey").cast("string"))
    pair = F.array(
        F.struct(F.lit("en").alias("lang"), key.alias("key"), F.col("name_en").alias("text")),
        F.struct(F.lit("ar").alias("lang"), key.alias("key"), F.col("name_alt").alias("text")),
    )
    both = places.select("p_size", F.explode(pair).alias("e")).filter("e.lang = 'en' or p_size <= 25")
    return both.select("e.*")


LOCALES = {"de": "ar_EG", "en": "en", "es": " AR ", "fr": "arabic"}
LOCALE_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LOCALES.items()) + " END"


def _locale():
    out = F.lit(None).cast("string")
    for lang, tag in LOCALES.items():
        out = F.when(F.col("lang") == lang, tag).otherwise(out)
    return out


RESOLVE_SQL = "CASE WHEN regexp_full_match(replace(lower(trim({c})), '_', '-'), 'ar(-[a-z0-9]{{1,8}})*') THEN 'ar' ELSE 'en' END"


@query(
    "join_translation",
    b.with_sql(
        DICTIONARY_SQL,
        f"asked AS (SELECT doc_id, {LOCALE_SQL} AS lang, 'part.' || doc_id AS key FROM documents)",
        body=f"""SELECT doc_id, coalesce(d.text, a.key) AS text FROM asked a LEFT JOIN dictionary d
  ON d.key = a.key AND d.lang = {RESOLVE_SQL.format(c='a.lang')}""",
    ),
)
def translation(t):
    asked = t.documents.select(
        "doc_id", _locale().alias("lang"), F.concat(F.lit("part."), F.col("doc_id").cast("string")).alias("key")
    )
    return dr.translate_keys(asked, _dictionary(t)).select("doc_id", "text")


@query(
    "txt_language_resolve",
    f"""SELECT doc_id, {RESOLVE_SQL.format(c=LOCALE_SQL)} AS lang, CASE {RESOLVE_SQL.format(c=LOCALE_SQL)} WHEN 'ar' THEN 'rtl' ELSE 'ltr' END AS direction
FROM documents""",
)
def language_resolve(t):
    from concourse.functions.text import resolve_language, text_direction

    return t.documents.select(
        "doc_id", resolve_language(_locale()).alias("lang"), text_direction(_locale()).alias("direction")
    )


@query(
    "txt_dictionary_parity",
    b.with_sql(
        DICTIONARY_SQL,
        body="""SELECT key, max(CAST(lang = 'en' AND length(trim(text)) > 0 AS INTEGER)) AS has_en, max(CAST(lang = 'ar' AND length(trim(text)) > 0 AS INTEGER)) AS has_ar
FROM dictionary GROUP BY key HAVING min(lang) = max(lang)""",
    ),
)
def dictionary_parity(t):
    return dr.dictionary_gaps(_dictionary(t))


@query(
    "join_schedule_labels",
    """WITH first AS (SELECT p_size AS number, min(p_partkey) AS label_id FROM part GROUP BY p_size)
SELECT s_suppkey AS code, label_id, p_name AS label_name, label_id IS NULL AS label_missing
FROM supplier LEFT JOIN first ON number = s_suppkey LEFT JOIN part ON p_partkey = label_id""",
)
def schedule_labels(t):
    schedule = t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_suppkey").cast("int").alias("number"))
    labels = t.part.select(
        F.col("p_size").alias("number"),
        F.col("p_partkey").alias("label_ord"),
        F.col("p_partkey").alias("label_id"),
        F.col("p_name").alias("label_name"),
    )
    return dr.match_schedule(schedule, labels).select("code", "label_id", "label_name", "label_missing")


@query(
    "join_evidence_trace",
    b.with_sql(
        b.PATHS_SQL,
        body="""SELECT o_orderkey AS ref_id, o_orderstatus || '#' || o_custkey AS ref FROM orders
WHERE NOT EXISTS (SELECT 1 FROM paths WHERE path_id = o_custkey AND CASE layer WHEN 'view' THEN 'F' WHEN 'click' THEN 'O' ELSE 'P' END = o_orderstatus AND layer <> 'error')""",
    ),
)
def evidence_trace(t):
    refs = t.orders.select(
        F.col("o_orderkey").alias("ref_id"), F.concat_ws("#", "o_orderstatus", F.col("o_custkey").cast("string")).alias("ref")
    )
    file = F.when(F.col("layer") == "view", "F").when(F.col("layer") == "click", "O").otherwise("P")
    raw = b.paths(t).select(file.alias("file"), F.col("path_id").cast("string").alias("record_id"), "layer")
    return rl.trace_evidence(refs, raw, F.col("layer") != "error").select("ref_id", "ref")


@query(
    "join_recompute_compare",
    f"""WITH a AS (SELECT vec_id, {b.dim_sql(0, 1000)} AS x, {b.dim_sql(1, 1000)} AS y, label FROM embeddings),
z AS (SELECT CASE WHEN label < 8 THEN vec_id ELSE -1 - vec_id END AS vec_id, {b.dim_sql(0, 100)} * 10 AS x, {b.dim_sql(1, 100)} * 10 AS y, label FROM embeddings)
SELECT vec_id, round(sqrt((a.x - z.x) * (a.x - z.x) + (a.y - z.y) * (a.y - z.y)), 4) AS drift, a.x IS NULL OR z.x IS NULL AS missing
FROM a FULL JOIN z USING (vec_id) WHERE a.x IS NULL OR z.x IS NULL OR (a.x - z.x) * (a.x - z.x) + (a.y - z.y) * (a.y - z.y) >= 16""",
)
def recompute_compare(t):
    stored = b.points(t).select(F.col("point_id").alias("vec_id"), "x", "y")
    # Rows of two labels are recomputed under another key, so they are missing under their own.
    key = F.when(F.col("label") < 8, F.col("vec_id")).otherwise(-1 - F.col("vec_id"))
    computed = t.embeddings.select(
        key.alias("vec_id"), (b.dim(0, 100) * 10).alias("x"), (b.dim(1, 100) * 10).alias("y")
    )
    return rl.recompute_diff(stored, computed, ["vec_id"], ("x", "y"), 4.0).select(
        "vec_id", F.round("drift", 4).alias("drift"), "missing"
    )


@query(
    "join_anchor_nearest",
    """WITH a AS (SELECT doc_id AS a_id, source || lang AS anchor, doc_id AS ax, n_chars AS ay FROM documents WHERE n_chars > 2000),
z AS (SELECT doc_id AS z_id, source || lang AS anchor, doc_id AS zx, n_chars AS zy FROM documents WHERE n_chars <= 2000),
pairs AS (SELECT anchor, a_id, z_id, (ax - zx - 100) * (ax - zx - 100) + (ay - zy - 1000) * (ay - zy - 1000) AS d2 FROM a JOIN z USING (anchor))
SELECT anchor, min((d2, a_id, z_id))[2] AS a_id, min((d2, a_id, z_id))[3] AS z_id, round(sqrt(min(d2)), 4) AS residual FROM pairs GROUP BY anchor""",
)
def anchor_nearest(t):
    from concourse.operators.spatial import nearest_pairs

    rows = t.documents.select(F.concat("source", "lang").alias("anchor"), "doc_id", F.col("n_chars"))
    a = rows.filter("n_chars > 2000").select("anchor", F.col("doc_id").alias("a_id"), F.col("doc_id").alias("ax"), F.col("n_chars").alias("ay"))
    z = rows.filter("n_chars <= 2000").select("anchor", F.col("doc_id").alias("z_id"), F.col("doc_id").alias("zx"), F.col("n_chars").alias("zy"))
    best = nearest_pairs(a, z, 100, 1000)
    return best.select("anchor", "a_id", "z_id", F.round("residual", 4).alias("residual"))


@query(
    "win_first_match",
    "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority",
)
def first_match(t):
    hits = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey")
    return first_per(hits, ["o_custkey", "o_orderpriority"], ["o_orderkey"])
