"""Measures of vertex tables: lengths, areas, boxes, hulls and grouped counts.

A vertex table holds one row per vertex: key columns, ``ord``, ``x`` and ``y``.  Consecutive
vertices are paired by the chunked scans, so one outline may own any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions.geometry import cross, is_finite, norm
from concourse.operators.ordered import neighbours, ordinal_chunk
from concourse.session import partitions

PREVIEW_PAD, PREVIEW_MIN_WIDTH, PREVIEW_MIN_HEIGHT = 70.0, 220.0, 150.0


def path_segments(
    vertices: DataFrame, key: str, order: Sequence[str] = ("ord",), chunk: Column | None = None
) -> DataFrame:
    """Each vertex with the next one of its track as (nx, ny); NULL after the last."""
    return neighbours(vertices, [key], order, chunk if chunk is not None else ordinal_chunk("ord"), next={"nx": "x", "ny": "y"})


def ring_segments(vertices: DataFrame, key: str) -> DataFrame:
    """Each vertex with its successor, the last one closing back to the first."""
    shifts = {"next": {"nx": "x", "ny": "y"}, "first": {"_fx": "x", "_fy": "y"}}
    paired = neighbours(vertices, [key], ["ord"], ordinal_chunk("ord"), **shifts)
    last = F.col("nx").isNull() & F.col("ny").isNull()
    closing = [F.when(last, F.col(f)).otherwise(F.col(n)).alias(n) for f, n in (("_fx", "nx"), ("_fy", "ny"))]
    return paired.select(*vertices.columns, *closing)


def polyline_length(vertices: DataFrame, key: str, order=("ord",), chunk: Column | None = None) -> DataFrame:
    """Length per track; NaN as soon as any vertex is not a real number."""
    seg = path_segments(vertices, key, order, chunk)
    bad = ~(is_finite(F.col("x").cast("double")) & is_finite(F.col("y").cast("double")))
    step = norm(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    sums = seg.groupBy(key).agg(F.coalesce(F.sum(F.when(~bad, step)), F.lit(0.0)).alias("_sum"), F.max(bad).alias("_bad"))
    return sums.select(key, F.when(F.col("_bad"), F.lit(float("nan"))).otherwise(F.col("_sum")).alias("length"))


def arc_length(vertices: DataFrame, key: str, order=("ord",), chunk: Column | None = None) -> DataFrame:
    """Length per track over the measurable segments only."""
    seg = path_segments(vertices, key, order, chunk)
    step = norm(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    return seg.groupBy(key).agg(F.coalesce(F.sum(F.when(is_finite(step), step)), F.lit(0.0)).alias("length"))


def polygon_area(vertices: DataFrame, key: str) -> DataFrame:
    """Signed shoelace area; positive when the outline runs clockwise on screen."""
    seg = ring_segments(vertices, key)
    twice = F.sum(cross(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))
    return seg.groupBy(key).agg((twice / F.lit(2.0)).alias("area"))


def bounds(vertices: DataFrame, key: str) -> DataFrame:
    return vertices.groupBy(key).agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y")
    )


def preview_frame(vertices: DataFrame, key: str) -> DataFrame:
    """Padded frame centred on the outline, never smaller than the minimum preview size."""
    box = bounds(vertices, key)
    width = F.greatest(F.col("max_x") - F.col("min_x") + PREVIEW_PAD, F.lit(PREVIEW_MIN_WIDTH))
    height = F.greatest(F.col("max_y") - F.col("min_y") + PREVIEW_PAD, F.lit(PREVIEW_MIN_HEIGHT))
    return box.select(
        key,
        ((F.col("min_x") + F.col("max_x")) / 2 - width / 2).alias("left"),
        ((F.col("min_y") + F.col("max_y")) / 2 - height / 2).alias("top"),
        width.alias("width"),
        height.alias("height"),
    )


def _hull(xy: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of lexicographically distinct points (monotone chain)."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1:
                u, v = out[-1] - out[-2], p - out[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))



def convex_hull(points: DataFrame, key: str) -> DataFrame:
    """Hull vertices per key in order.

    A hull of partial hulls is the hull, so slices of a key are hulled apart and only their hull
    vertices meet; each level is an Arrow batch function over the groups Spark formed.
    """
    salted = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(partitions(points))))
    key_type = points.schema[key].dataType.simpleString()

    def hull_of(keep_salt: bool):
        def run(keys: tuple, table: pa.Table) -> pa.Table:
            xy = np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()])
            hull = _hull(xy)
            n = len(hull)
            cols = {
                key: pa.array([keys[0].as_py()] * n, table[key].type),
                "ord": pa.array(np.arange(n), pa.int64()),
                "x": pa.array(hull[:, 0], pa.float64()),
                "y": pa.array(hull[:, 1], pa.float64()),
            }
            return pa.table(cols)

        return run

    schema = f"{key} {key_type}, ord long, x double, y double"
    partial = salted.groupBy(key, "_salt").applyInArrow(hull_of(True), schema)
    return partial.groupBy(key).applyInArrow(hull_of(False), schema)


def layer_counts(paths: DataFrame, by: str = "layer") -> DataFrame:
    return paths.groupBy(by).agg(F.count(F.lit(1)).alias("paths")).orderBy(by)


def occupants(hits: DataFrame, face: str, label: str) -> DataFrame:
    """Distinct sorted labels per face; labels are deduplicated before they are collected."""
    return hits.select(face, label).distinct().groupBy(face).agg(F.sort_array(F.collect_list(label)).alias("occupants"))


def cycle_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Independent cycles of a connected graph: edges - nodes + 1."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    counted = edges.agg(F.count(F.lit(1)).alias("edges")).select("edges", n.scalar().alias("nodes"))
    return counted.withColumn("cycles", F.col("edges") - F.col("nodes") + 1)


def endpoint_kinds(df: DataFrame, kind: str, note: str) -> DataFrame:
    """Endpoints per kind ('unknown' when unset) and how many carry a note."""
    return df.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("kind")).agg(
        F.count(F.lit(1)).alias("endpoints"), F.count_if(F.col(note).isNotNull()).alias("qualified")
    )


def evidence_gate(elements: DataFrame, key: str) -> DataFrame:
    """Graphs marked confirmed that hold an unconfirmed element; elements: key, graph_status, status."""
    return elements.groupBy(key).agg(
        F.max("graph_status").alias("graph_status"),
        F.count_if(F.col("status") != "confirmed").alias("unconfirmed"),
        ((F.max("graph_status") != "confirmed") | F.bool_and(F.col("status") == "confirmed")).alias("passes"),
    )


def geometry_summary(places: DataFrame) -> DataFrame:
    return places.agg(
        F.count(F.lit(1)).alias("places"),
        F.count_if(F.col("geometry_status") != "unknown").alias("with_outline"),
        F.count_if(F.col("geometry_status") == "unknown").alias("unresolved"),
        F.count_if(F.col("geometry_status") == "confirmed").alias("confirmed"),
    )
