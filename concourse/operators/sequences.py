"""Reading-order patterns over spans, rings and polylines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions.geometry import cross, dist
from concourse.operators.ordered import islands, neighbours, ordinal_chunk

# Room code pattern of the schedule and heading bands in degrees.
SCHEDULE_CODE = r"^G-[0-9]+$"
STRAIGHT_BELOW, SLIGHT_BELOW, BAND_GUARD = 15.0, 45.0, 1e-7


def schedule_rows(
    spans: DataFrame, key: str = "source_id", is_code: Column | None = None, chunk: Column | None = None
) -> DataFrame:
    """A code span followed by its name span, in reading order."""
    chunk = chunk if chunk is not None else ordinal_chunk("ord")
    paired = neighbours(spans, [key], ["ord"], chunk, next={"name": "text", "name_ord": "ord"})
    code = is_code if is_code is not None else F.col("text").rlike(SCHEDULE_CODE)
    return paired.filter(code & F.col("name_ord").isNotNull()).withColumn("name", F.trim("name"))


def plan_labels(
    spans: DataFrame,
    key: str = "source_id",
    is_mark: Column | None = None,
    is_tag: str = "tag_text rlike '^[0-9]+$'",
    chunk: Column | None = None,
) -> DataFrame:
    """Label triplets (tag, name, mark): the two spans before a mark, kept when the first one is a tag."""
    chunk = chunk if chunk is not None else ordinal_chunk("ord")
    before = {"prev": {"name_text": "text", "name_ord": "ord"}, "prev2": {"tag_text": "text", "tag_ord": "ord"}}
    two = neighbours(spans, [key], ["ord"], chunk, **before)
    mark = is_mark if is_mark is not None else F.col("text") == "G"
    return two.filter(mark & F.col("tag_ord").isNotNull()).filter(is_tag)


def clean_ring_rows(vertices: DataFrame, key: str, eps: float) -> DataFrame:
    """Drop vertices that repeat their predecessor and a closing vertex that repeats the first one."""
    first = {"_fo": "ord", "_fx": "x", "_fy": "y"}
    n = neighbours(vertices, [key], ["ord"], ordinal_chunk("ord"), prev={"px": "x", "py": "y"}, next={"_no": "ord"}, first=first)
    repeat = F.coalesce(dist(F.col("x"), F.col("y"), F.col("px"), F.col("py")) <= eps, F.lit(False))
    last = F.col("_no").isNull() & (F.col("ord") != F.col("_fo"))
    closing = last & (dist(F.col("x"), F.col("y"), F.col("_fx"), F.col("_fy")) <= eps)
    return n.filter(~repeat & ~closing).select(*vertices.columns)


def join_polylines(points: DataFrame, key: str, order: Sequence[str], chunk: Column, eps: float = 1e-7, scope: Sequence[str] = ()) -> DataFrame:
    """Concatenated step geometries without points that repeat the one before; ``scope`` names columns that go with the key."""
    n = neighbours(points, [*scope, key], order, chunk, prev={"px": "x", "py": "y"})
    repeat = F.coalesce(dist(F.col("x"), F.col("y"), F.col("px"), F.col("py")) <= eps, F.lit(False))
    return n.filter(~repeat).drop("px", "py")


def heading_change(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Signed heading change in degrees; right turns are positive because y grows downward."""
    return F.degrees(F.atan2(cross(ux, uy, vx, vy), ux * vx + uy * vy))


def turn_of(angle: Column) -> Column:
    size = F.abs(angle)
    side = F.when(angle < 0, "left").otherwise("right")
    return (
        F.when(size < STRAIGHT_BELOW - BAND_GUARD, "continue")
        .when(size < SLIGHT_BELOW - BAND_GUARD, F.concat(F.lit("slight-"), side))
        .otherwise(side)
    )


def turns(segments: DataFrame, key: str, order: Sequence[str], chunk: Column) -> DataFrame:
    """Heading change from the previous segment; segments(dx, dy) must have length."""
    n = neighbours(segments, [key], order, chunk, prev={"pdx": "dx", "pdy": "dy"})
    angle = heading_change(F.col("pdx"), F.col("pdy"), F.col("dx"), F.col("dy"))
    return n.filter("pdx is not null").withColumn("angle", angle).withColumn("turn", turn_of(angle)).drop("pdx", "pdy")


def fold_continue(
    instructions: DataFrame, key: str, order: Sequence[str], chunk: Column, scope: Sequence[str] = ()
) -> DataFrame:
    """Fold runs of adjacent 'continue' rows into the first one, summing distance with NULL as zero."""
    keys = [*scope, key]
    go_on = lambda row, before: ~((row["type"] == "continue") & (before["type"] == "continue"))
    island = islands(instructions, keys, order, chunk, go_on, "_island")
    rest = [c for c in instructions.columns if c not in (*keys, "distance")]
    rank = F.struct(*[F.col(c) for c in order])
    folded = island.groupBy(*keys, "_island").agg(
        F.min_by(F.struct(*rest), rank).alias("_row"),
        F.count(F.lit(1)).alias("_n"),
        F.max("distance").alias("_one"),
        F.sum(F.coalesce("distance", F.lit(0.0))).alias("_sum"),
    )
    distance = F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.col("_sum"))
    return folded.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], distance.alias("distance")).select(
        *instructions.columns
    )


def intervals(cuts: DataFrame, key: str, per_chunk: int = 64) -> DataFrame:
    """Consecutive distinct cut parameters as intervals (t0, t1); cuts lie in 0..1."""
    distinct = cuts.select(key, "t").distinct()
    chunk = F.floor(F.col("t") * per_chunk)
    paired = neighbours(distinct, [key], ["t"], chunk, next={"t1": "t"})
    return paired.filter("t1 is not null").select(key, F.col("t").alias("t0"), "t1")
