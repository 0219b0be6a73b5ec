"""Directory projections and lookups: scope, facets, content, availability, origins, translations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions.text import resolve_language
from concourse.operators.ordered import first_per


def visible_places(places: DataFrame, building: str | Column, floor: str | Column) -> DataFrame:
    """Public places of the active building and floor."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return places.filter(
        F.col("is_public") & (F.col("building_id") == as_col(building)) & (F.col("floor_id") == as_col(floor))
    )


def facet(places: DataFrame, category: str = "all") -> DataFrame:
    return places if category == "all" else places.filter(F.col("category") == category)


def categories(places: DataFrame, ord_col: str) -> DataFrame:
    """Distinct categories in order of first appearance."""
    return places.groupBy("category").agg(F.min(ord_col).alias("first_seen")).orderBy("first_seen")


def with_content(places: DataFrame, content: DataFrame, default: str) -> DataFrame:
    """Place with its description; missing or empty text falls back to ``default``."""
    described = F.when(F.length("description") > 0, F.col("description"))
    return places.join(content, "content_ref", "left").withColumn("description", F.coalesce(described, F.lit(default)))


def summary_text(df: DataFrame, name: str, code: str = "code", description: str = "description") -> DataFrame:
    """Spoken summary ``name. code. description``."""
    return df.withColumn("summary", F.concat_ws(". ", F.col(name), F.col(code), F.col(description)))


def overlay(places: DataFrame, overrides: DataFrame) -> DataFrame:
    """Availability per place: absent means available; unavailable only blocks use as a destination."""
    joined = places.join(overrides, "place_id", "left")
    status = F.coalesce("status", F.lit("available"))
    return joined.withColumn("status", status).withColumn("can_be_destination", status == "available")


def translate_keys(requests: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Text for (lang, key); unsupported languages read English, unknown keys stay visible as themselves."""
    asked = requests.withColumn("_lang", resolve_language(F.col("lang")))
    texts = dictionary.select(F.col("lang").alias("_lang"), "key", "text")
    return asked.join(texts, ["_lang", "key"], "left").withColumn("text", F.coalesce("text", "key")).drop("_lang")


def dictionary_gaps(dictionary: DataFrame, languages: Sequence[str] = ("en", "ar")) -> DataFrame:
    """Keys that lack a non-blank text in one of the languages."""
    have = [
        F.max(F.when((F.col("lang") == lang) & (F.length(F.trim("text")) > 0), 1).otherwise(0)).alias(f"has_{lang}")
        for lang in languages
    ]
    missing = [F.col(f"has_{lang}") == 0 for lang in languages]
    gap = missing[0]
    for m in missing[1:]:
        gap = gap | m
    return dictionary.groupBy("key").agg(*have).filter(gap)


def resolve_origin(requests: DataFrame, kiosks: DataFrame, places: DataFrame) -> DataFrame:
    """Start node of each request.

    A chosen start place wins even when it has no node (the answer is then NULL); else a confirmed
    kiosk's node, the kiosk being the configured one or the floor's only one; else the default place.
    requests: request_id, scope_id, kiosk_id, custom_place_id, default_place_id;
    kiosks: kiosk_id, scope_id, node_id, status; places: place_id, door_node.
    """
    only = kiosks.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("kiosk_id", "node_id", "status")).alias("_only")
    )
    named = kiosks.select("kiosk_id", "scope_id", F.struct("kiosk_id", "node_id", "status").alias("_named"))
    doors = places.select("place_id", "door_node")
    custom = doors.select(F.col("place_id").alias("custom_place_id"), F.col("door_node").alias("_custom_node"))
    default = doors.select(F.col("place_id").alias("default_place_id"), F.col("door_node").alias("_default_node"))
    joined = (
        requests.join(named, ["kiosk_id", "scope_id"], "left")
        .join(only.filter("_n = 1"), "scope_id", "left")
        .join(custom, "custom_place_id", "left")
        .join(default, "default_place_id", "left")
    )
    kiosk = F.when(F.col("kiosk_id").isNotNull(), F.col("_named")).otherwise(F.col("_only"))
    kiosk_node = F.when(kiosk["status"] == "confirmed", kiosk["node_id"])
    chosen = F.col("custom_place_id").isNotNull()
    start = F.when(chosen, F.col("_custom_node")).otherwise(F.coalesce(kiosk_node, "_default_node"))
    via = (
        F.when(chosen, "custom")
        .when(kiosk_node.isNotNull(), "kiosk")
        .when(F.col("_default_node").isNotNull(), "default")
        .otherwise("none")
    )
    return joined.select(*requests.columns, start.alias("start_node"), via.alias("origin"))


def partial_routes(routes: DataFrame, places: DataFrame) -> DataFrame:
    """Routes with a flag: either endpoint place lacks its final connection."""
    flags = places.select("place_id", F.coalesce("is_partial", F.lit(False)).alias("_p"))
    start = flags.select(F.col("place_id").alias("start_place"), F.col("_p").alias("_sp"))
    end = flags.select(F.col("place_id").alias("end_place"), F.col("_p").alias("_ep"))
    both = F.coalesce("_sp", F.lit(False)) | F.coalesce("_ep", F.lit(False))
    return routes.join(start, "start_place", "left").join(end, "end_place", "left").select(
        *routes.columns, both.alias("is_partial")
    )


def match_schedule(schedule: DataFrame, labels: DataFrame) -> DataFrame:
    """Schedule row with the first plan label of its number; ``label_missing`` marks an error."""
    first = first_per(labels.select("number", "label_ord", "label_id", "label_name"), ["number"], ["label_ord"])
    return schedule.join(first, "number", "left").withColumn("label_missing", F.col("label_id").isNull())


def display_distance(distance: Column, unit: Column) -> Column:
    """Whole metres, half up; drawing units show no number."""
    return F.when(unit == "meter", F.floor(distance + 0.5).cast("long"))


def selected_first(places: DataFrame, selected: Column, ord_col: str) -> DataFrame:
    return places.orderBy(selected.desc(), F.col(ord_col))
