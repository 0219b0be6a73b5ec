"""Floor bundles: JSON documents with a fixed schema, unfolded into normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The versioned document schemas.
LOCALIZED = "STRUCT<en STRING, ar STRING>"
EVIDENCE = "ARRAY<STRUCT<source STRING, page DOUBLE, note STRING, status STRING>>"
POINT, RING = "ARRAY<DOUBLE>", "ARRAY<ARRAY<DOUBLE>>"
FLOOR_DOC = f"""schemaVersion INT, building STRUCT<id STRING, name {LOCALIZED}, floorIds ARRAY<STRING>>,
floor STRUCT<id STRING, buildingId STRING, name {LOCALIZED}, level DOUBLE, viewBox {POINT}, mapAsset STRING,
  metersPerUnit DOUBLE, calibrationStatus STRING>,
rooms ARRAY<STRUCT<id STRING, code STRING, buildingId STRING, floorId STRING, name {LOCALIZED}, category STRING,
  polygon {RING}, geometryRef STRING, centroid {POINT}, doorNodeId STRING, aliases ARRAY<STRING>, contentRef STRING,
  navigationNote {LOCALIZED}, navigationPartial BOOLEAN,
  availability STRUCT<status STRING, reason {LOCALIZED}, configurationId STRING, roomId STRING>,
  public BOOLEAN, geometryStatus STRING, provenance {EVIDENCE}>>,
kiosks ARRAY<STRUCT<id STRING, buildingId STRING, floorId STRING, name {LOCALIZED}, nodeId STRING, status STRING>>,
mapFeatures ARRAY<STRUCT<id STRING, buildingId STRING, floorId STRING, name {LOCALIZED}, kind STRING, polygon {RING},
  geometryStatus STRING, accessibility STRING, connectedFloorIds ARRAY<STRING>, provenance {EVIDENCE}>>,
navigationDefaults STRUCT<startRoomId STRING>"""
GRAPH_DOC = f"""routingPolicy STRING, metersPerUnit DOUBLE, calibrationStatus STRING, status STRING,
navigableAreas ARRAY<{RING}>, walls ARRAY<{RING}>,
nodes ARRAY<STRUCT<id STRING, buildingId STRING, floorId STRING, point {POINT}, type STRING, roomId STRING, status STRING>>,
edges ARRAY<STRUCT<id STRING, `from` STRING, `to` STRING, floorId STRING, pathType STRING, distance DOUBLE,
  distanceUnit STRING, accessibility STRING, restriction STRING, status STRING, bidirectional BOOLEAN, geometry {RING}>>"""
CONTENT_DOC = f"ARRAY<STRUCT<id STRING, description {LOCALIZED}, placeholder BOOLEAN, image STRING, imageAlt {LOCALIZED}>>"
FLOOR_PATH = r"data/buildings/([^/]+)/([^/]+?)(\.graph|\.review|\.[^/]*\.review)?\.json$"
CONTENT_PATH = r"content/([^/]+)/([^/]+?)\.json$"
JSON_OPTIONS = {"allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def floor_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Floor documents among file paths, with the ids their path states; graph and review siblings are left out."""
    part = lambda i: F.regexp_extract(path, FLOOR_PATH, i)
    return paths.withColumns({"path_building": part(1), "path_floor": part(2)}).filter(
        (F.col("path_building") != "") & (part(3) == "")
    )


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Floor documents below ``root`` without reading their content."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .load(root)
        .select("path")
    )
    return floor_files(listed)


def path_id_mismatches(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows where an id stated by the path differs from the id inside the document."""
    agree = F.lit(True)
    for stated, inside in pairs:
        agree = agree & F.col(stated).eqNullSafe(F.col(inside))
    return df.filter(~agree)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per floor: bundle_id, path ids and the three parsed documents."""
    files = (
        spark.read.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .load(root)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    floors = floor_files(files).select("path_building", "path_floor", F.col("value").alias("floor_json"))

    def sibling(pattern: str, kind: str | None, name: str) -> DataFrame:
        part = lambda i: F.regexp_extract("path", pattern, i)
        rows = files.select(part(1).alias("path_building"), part(2).alias("path_floor"), F.col("value").alias(name), *(
            [part(3).alias("_kind")] if kind else []
        )).filter("path_building <> ''")
        return rows.filter(F.col("_kind") == kind).drop("_kind") if kind else rows

    ids = ["path_building", "path_floor"]
    joined = floors.join(sibling(FLOOR_PATH, ".graph", "graph_json"), ids, "left").join(
        sibling(CONTENT_PATH, None, "content_json"), ids, "left"
    )
    return parse_documents(joined.withColumn("bundle_id", F.concat_ws("/", *ids)))


def parse_documents(texts: DataFrame) -> DataFrame:
    """Parse floor_json, graph_json and content_json by the fixed schemas."""
    return texts.withColumns(
        {
            "doc": F.from_json("floor_json", FLOOR_DOC, JSON_OPTIONS),
            "graph": F.from_json("graph_json", GRAPH_DOC, JSON_OPTIONS),
            "contents": F.from_json("content_json", CONTENT_DOC, JSON_OPTIONS),
            # Absent and null differ for these two members.
            "has_features": F.get_json_object("floor_json", "$.mapFeatures").isNotNull(),
            "has_defaults": F.get_json_object("floor_json", "$.navigationDefaults").isNotNull(),
        }
    ).drop("floor_json", "graph_json", "content_json")


def xy(points: Column) -> Column:
    """Coordinate pairs as structs; a pair of another length keeps NULL coordinates."""
    return F.transform(points, point_of)


def point_of(pair: Column) -> Column:
    two = F.size(pair) == 2
    return F.struct(F.when(two, F.get(pair, F.lit(0))).alias("x"), F.when(two, F.get(pair, F.lit(1))).alias("y"))


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """Normalised tables of all bundles; ``ord`` keeps the position inside the document."""
    def members(array: str, *more: Column) -> DataFrame:
        spread = documents.select("bundle_id", *more, F.posexplode(array).alias("ord", "m"))
        return spread.select("bundle_id", "ord", *[c for c in spread.columns if c not in ("bundle_id", "ord", "m")], "m.*")

    floors = documents.select(
        "bundle_id",
        F.col("doc.schemaVersion").alias("schema_version"),
        F.col("doc.building.id").alias("building_id"),
        F.col("doc.building.name").alias("building_name"),
        F.col("doc.building.floorIds").alias("floor_ids"),
        F.col("doc.floor.id").alias("floor_id"),
        F.col("doc.floor.buildingId").alias("floor_building_id"),
        F.col("doc.floor.name").alias("name"),
        F.col("doc.floor.level").alias("level"),
        F.col("doc.floor.viewBox").alias("view_box"),
        F.col("doc.floor.mapAsset").alias("map_asset"),
        F.col("doc.floor.metersPerUnit").alias("meters_per_unit"),
        F.col("doc.floor.calibrationStatus").alias("calibration_status"),
        F.col("doc.navigationDefaults.startRoomId").alias("start_room_id"),
        "has_defaults",
    )
    graphs = documents.select(
        "bundle_id",
        F.col("graph.routingPolicy").alias("policy"),
        F.col("graph.metersPerUnit").alias("meters_per_unit"),
        F.col("graph.calibrationStatus").alias("calibration_status"),
        F.col("graph.status").alias("status"),
        F.size("graph.navigableAreas").alias("n_areas"),
        F.size("graph.walls").alias("n_walls"),
    )
    places = members("doc.rooms").withColumns({"ring": xy(F.col("polygon")), "anchor": point_of(F.col("centroid"))})
    features = members("doc.mapFeatures").withColumn("ring", xy(F.col("polygon")))
    nodes = members("graph.nodes").withColumn("xy", point_of(F.col("point")))
    edges = members("graph.edges").withColumn("path", xy(F.col("geometry")))
    areas = documents.select("bundle_id", F.posexplode("graph.navigableAreas").alias("ord", "a")).select(
        "bundle_id", "ord", xy(F.col("a")).alias("ring")
    )
    walls = documents.select("bundle_id", F.posexplode("graph.walls").alias("ord", "w")).select(
        "bundle_id", "ord", xy(F.col("w")).alias("path")
    )
    content = documents.select("bundle_id", F.posexplode("contents").alias("ord", "m")).select("bundle_id", "ord", "m.*")
    return {
        "floors": floors,
        "graphs": graphs,
        "places": places.drop("polygon", "centroid"),
        "kiosks": members("doc.kiosks"),
        "features": features.drop("polygon"),
        "nodes": nodes.drop("point"),
        "edges": edges.drop("geometry"),
        "areas": areas,
        "walls": walls,
        "content": content,
    }


def read_bundles(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Normalised tables of every floor bundle below ``root``."""
    return tables(read_documents(spark, root))
