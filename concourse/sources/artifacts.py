"""Asset rules, digests, drawing documents and keyed configuration objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a drawing asset must and must not contain.
VIEW_BOX = r"""\bviewBox\s*=\s*["']([^"']+)["']"""
EMBEDDED = r"(?i)<(?:image|script)\b"
VIEW_BOX_SLACK = 1e-5


def asset_violations(assets: DataFrame, floors: DataFrame) -> DataFrame:
    """Broken asset rules: assets(asset_id, body), floors(asset_id, view_box ARRAY<DOUBLE>)."""
    raw = F.trim(F.regexp_extract("body", VIEW_BOX, 1))
    numbers = F.transform(F.split(raw, r"[\s,]+"), lambda v: v.try_cast("double"))
    joined = assets.withColumn("_box", numbers).join(floors, "asset_id", "left")
    close = F.forall(
        F.zip_with("_box", "view_box", lambda a, b: F.coalesce(F.abs(a - b) <= VIEW_BOX_SLACK, F.lit(False))), lambda v: v
    )
    agrees = (F.size("_box") == 4) & F.coalesce(close, F.lit(False))
    rules = F.array_compact(
        F.array(F.when(~agrees, "view box differs"), F.when(F.col("body").rlike(EMBEDDED), "embedded image or script"))
    )
    return joined.select("asset_id", F.explode(rules).alias("rule"))


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as (name relative to it, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", F.lit("^.*?" + root.rstrip("/").replace(".", r"\.") + "/"), F.lit(""))
    return files.select(relative.alias("name"), "content")


def explode_spans(documents: DataFrame, key: str, spans: Column) -> DataFrame:
    """Text spans in reading order with ids from their ordinal; array order is meaning."""
    spread = documents.select(F.col(key).cast("string").alias("source_id"), F.posexplode(spans).alias("ord", "span"))
    return spread.withColumn("id", F.format_string("%s-text-%04d", "source_id", "ord"))


def explode_paths(documents: DataFrame, key: str, paths: Column) -> DataFrame:
    """Paths in drawing order with ids from their ordinal."""
    spread = documents.select(F.col(key).cast("string").alias("source_id"), F.posexplode(paths).alias("ord", "path"))
    return spread.withColumn("id", F.format_string("%s-path-%05d", "source_id", "ord"))


def path_items(paths: DataFrame, items: Column) -> DataFrame:
    """Typed geometry items of each path; a path without items keeps one row."""
    return paths.select(F.col("id").alias("path_id"), F.posexplode_outer(items).alias("item_ord", "item"))


def map_to_rows(df: DataFrame, json_col: str, value_type: str = "STRING") -> DataFrame:
    """Object keyed by code -> one row per member."""
    parsed = F.from_json(json_col, f"MAP<STRING,{value_type}>")
    rest = [c for c in df.columns if c != json_col]
    return df.select(*rest, F.explode(parsed).alias("code", "entry"))
