"""Sources and sinks exercised on documents, pages and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from concourse.operators import relational as rl
from concourse.plans.registry import query
from concourse.session import ensure_checkpoint_dir
from concourse.sources import artifacts as ar
from concourse.sources import bundles as bu
from concourse.sources.sinks import write_named, write_stable


def _folder(t, purpose: str) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


@query(
    "src_bundle_json",
    """SELECT replace(p_brand, '#', '-') || '/F' || p_size AS bundle_id, p_brand || '-' || p_partkey || s AS place_id, p_name AS name_en, upper(p_name) AS name_ar,
  p_type AS category, CAST(p_retailprice AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_size <= 40 AS is_public, s = '-a' AS has_alias
FROM part, (SELECT unnest(['-a', '-b']) AS s)""",
)
def bundle_json(t):
    """Parts of one brand and size are the rooms of a floor; floors, graphs and contents are written as files and read back."""
    key = F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string"))

    def room(suffix, aliases):
        return F.struct(
            F.concat(key, F.lit(suffix)).alias("id"),
            F.struct(F.col("p_name").alias("en"), F.upper("p_name").alias("ar")).alias("name"),
            F.col("p_type").alias("category"),
            F.array(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("centroid"),
            (F.col("p_size") <= 40).alias("public"),
            aliases.alias("aliases"),
        )

    rooms = F.array(room("-a", F.array("p_brand")), room("-b", F.array().cast("array<string>")))
    floors = t.part.groupBy(F.regexp_replace("p_brand", "#", "-").alias("b"), F.concat(F.lit("F"), F.col("p_size").cast("string")).alias("f"))
    floors = floors.agg(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.flatten(F.collect_list(rooms)).alias("rooms"))).alias("doc"))
    home = F.concat_ws("/", F.lit("data/buildings"), "b", "f")
    files = F.array(
        F.struct(F.concat(home, F.lit(".json")).alias("name"), F.col("doc").alias("content")),
        F.struct(F.concat(home, F.lit(".graph.json")).alias("name"), F.lit("{}").alias("content")),
        F.struct(F.concat_ws("/", F.lit("content"), "b", F.concat("f", F.lit(".json"))).alias("name"), F.lit("[]").alias("content")),
    )
    root = _folder(t, "bundles")
    write_named(floors.select(F.explode(files).alias("x")).select("x.*"), root)
    return bu.read_bundles(t.spark, root)["places"].select(
        "bundle_id",
        F.col("id").alias("place_id"),
        F.col("name.en").alias("name_en"),
        F.col("name.ar").alias("name_ar"),
        "category",
        F.col("anchor.x").alias("x"),
        F.col("anchor.y").alias("y"),
        F.col("public").alias("is_public"),
        (F.size("aliases") > 0).alias("has_alias"),
    )


SUFFIX_SQL = "CASE WHEN contains(url, '#') THEN '.graph.json' WHEN contains(url, '?') THEN '.shortest-paths.review.json' ELSE '.json' END"
LINK_SQL = "regexp_extract(url, 'example[.][a-z]+/([a-z]+)/([0-9]+)', {i})"


def _file_paths(t):
    link = r"example[.][a-z]+/([a-z]+)/([0-9]+)"
    suffix = (
        F.when(F.contains("url", F.lit("#")), ".graph.json")
        .when(F.contains("url", F.lit("?")), ".shortest-paths.review.json")
        .otherwise(".json")
    )
    path = F.concat(
        F.lit("file:/srv/data/buildings/"), F.regexp_extract("url", link, 1), F.lit("/"), F.regexp_extract("url", link, 2), suffix
    )
    return t.pages.select("page_id", path.alias("path"), F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("doc_building"))


@query(
    "src_discover_files",
    f"""SELECT DISTINCT {LINK_SQL.format(i=1)} AS path_building, {LINK_SQL.format(i=2)} AS path_floor FROM pages
WHERE {SUFFIX_SQL} = '.json' AND {LINK_SQL.format(i=1)} <> ''""",
)
def discover_files(t):
    """Floor, graph and review files of the pages' links are written, and the floors found among them by name."""
    name = F.regexp_extract("path", r"(data/buildings/.+)$", 1)
    root = _folder(t, "floors")
    write_named(_file_paths(t).select(name.alias("name"), F.lit("{}").alias("content")).distinct(), root)
    return bu.discover(t.spark, root).select("path_building", "path_floor")


@query(
    "src_path_id_agreement",
    f"""SELECT page_id FROM pages WHERE {SUFFIX_SQL} = '.json' AND {LINK_SQL.format(i=1)} <> ''
  AND ({LINK_SQL.format(i=1)} <> regexp_extract(html, '<html lang="([a-z]+)"', 1) OR {LINK_SQL.format(i=2)} <> CAST(page_id AS VARCHAR))""",
)
def path_id_agreement(t):
    rows = bu.floor_files(_file_paths(t)).withColumn("doc_floor", F.col("page_id").cast("string"))
    return bu.path_id_mismatches(rows, [("path_building", "doc_building"), ("path_floor", "doc_floor")]).select("page_id")


@query(
    "src_asset_text_rules",
    """WITH r AS (SELECT page_id AS asset_id, length(html) AS n, CASE WHEN contains(url, 'https') THEN 0 ELSE 1 END AS off, html FROM pages)
SELECT asset_id, 'view box differs' AS rule FROM r WHERE off = 1
UNION ALL SELECT asset_id, 'embedded image or script' FROM r WHERE regexp_matches(html, '<(image|script)\\b', 'i')""",
)
def asset_text_rules(t):
    n = F.length("html")
    head = F.format_string('<svg viewBox="0 0, %d %d">', F.col("page_id"), n)
    assets = t.pages.select(F.col("page_id").alias("asset_id"), F.concat(head, F.col("html")).alias("body"))
    off = F.when(F.contains("url", F.lit("https")), 0).otherwise(1)
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("page_id").cast("double"), (n + off).cast("double"))
    return ar.asset_violations(assets, t.pages.select(F.col("page_id").alias("asset_id"), box.alias("view_box")))


@query(
    "src_manifest_sha256",
    """SELECT 'chat/' || conv_id || '.txt' AS name, CASE WHEN count(*) = 2 THEN 'added' ELSE 'changed' END AS change FROM conversations
WHERE conv_id IS NOT NULL GROUP BY conv_id HAVING count(*) = 2 OR count(*) > 4""",
)
def manifest_sha256(t):
    """Transcripts are written as files and their bytes compared with a manifest that misses some and has old digests of others."""
    turn = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    kept = t.conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    name = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    files = kept.select(name.alias("name"), F.array_join("turns.line", "\n").alias("content"), F.size("turns").alias("n"))
    root = _folder(t, "transcripts")
    write_named(files, root)
    stale = F.when(F.col("n") > 4, F.concat("content", F.lit("."))).otherwise(F.col("content"))
    manifest = files.filter("n <> 2").select("name", F.sha2(stale, 256).alias("digest"))
    return rl.manifest_diff(ar.read_artifacts(t.spark, root), manifest)


@query(
    "src_regeneration_diff",
    """SELECT doc_id AS name, 'changed' AS change FROM documents WHERE contains(text, chr(10))""",
)
def regeneration_diff(t):
    name = F.col("doc_id").alias("name")
    before = t.documents.select(name, F.sha2("text", 256).alias("digest"))
    after = t.documents.select(name, F.sha2(F.regexp_replace("text", r"\n+", " "), 256).alias("digest"))
    return rl.snapshot_diff(before, after)


@query(
    "src_text_spans",
    """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS span, unnest(generate_series(0, len(lines) - 1)) AS ord FROM s)
SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(ord AS INTEGER) AS ord, doc_id || '-text-' || lpad(CAST(ord AS VARCHAR), CAST(greatest(4, length(CAST(ord AS VARCHAR))) AS INTEGER), '0') AS id, md5(span) AS span_hash FROM u""",
)
def text_spans(t):
    spans = ar.explode_spans(t.documents, "doc_id", F.split("text", "\n"))
    return spans.select("source_id", "ord", "id", F.md5("span").alias("span_hash"))


@query(
    "src_paths_items",
    """WITH p AS (SELECT vec_id, label, i, list_transform(embedding[i * 16 + 1:i * 16 + 16], lambda v: CAST(round(1000 * CAST(v AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings, (SELECT unnest(generate_series(0, 3)) AS i))
SELECT label || '-path-' || lpad(CAST(i AS VARCHAR), 5, '0') AS path_id, vec_id, CAST(j AS INTEGER) AS item_ord, CASE WHEN j = 0 THEN 'cubic' ELSE 'rect' END AS type,
  c[j * 8 + 1] || ',' || c[j * 8 + 2] || ' ' || c[j * 8 + 3] || ',' || c[j * 8 + 4] || ' ' || c[j * 8 + 5] || ',' || c[j * 8 + 6] || ' ' || c[j * 8 + 7] || ',' || c[j * 8 + 8] AS points
FROM p, (SELECT unnest([0, 1]) AS j)""",
)
def paths_items(t):
    def coord(i):
        return F.round(F.lit(1000) * F.get("embedding", i).cast("double")).cast("long").cast("string")

    def item(base, kind):
        pairs = [F.concat_ws(",", coord(base + F.lit(2 * k)), coord(base + F.lit(2 * k + 1))) for k in range(4)]
        return F.struct(F.lit(kind).alias("type"), F.concat_ws(" ", *pairs).alias("points"))

    def path(i):
        start = F.lit(16) * i
        return F.struct(F.col("vec_id").alias("vec_id"), F.array(item(start, "cubic"), item(start + 8, "rect")).alias("items"))

    drawn = ar.explode_paths(t.embeddings, "label", F.transform(F.sequence(F.lit(0), F.lit(3)), path))
    items = ar.path_items(drawn, F.transform("path.items", lambda v: F.struct(F.col("path.vec_id").alias("vec_id"), v.alias("it"))))
    return items.select(
        "path_id", F.col("item.vec_id").alias("vec_id"), "item_ord", F.col("item.it.type").alias("type"), F.col("item.it.points").alias("points")
    )


@query(
    "src_config_map",
    """SELECT event_id, 'k' AS code, json_extract_string(props, '$.k') AS entry FROM events""",
)
def config_map(t):
    return ar.map_to_rows(t.events.select("event_id", "props"), "props")


@query(
    "sink_stable_json",
    "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders",
)
def stable_json(t):
    """Written in key order and read back; the folder is the session's shared checkpoint folder."""
    path = _folder(t, "stable")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    write_stable(rows, path, ["o_orderkey"])
    return t.spark.read.schema(rows.schema).json(path)
