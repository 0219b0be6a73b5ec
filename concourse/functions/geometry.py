"""Planar predicates and measures as column expressions (x right, y down).

Rings and polylines travel as ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>``.  Divisions are avoided or
guarded, because ANSI mode evaluates them even behind a false conjunct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@dataclass(frozen=True)
class Tolerance:
    """Contact tolerance: ``eps`` scaled by segment length, with a floor for short segments.

    ``absolute`` compares the raw cross product, as point-in-outline tests do.
    """

    eps: float
    floor: float = 0.0
    absolute: bool = False

    def band(self, length: Column) -> Column:
        if self.absolute:
            return F.lit(self.eps)
        return F.lit(self.eps) * F.greatest(F.lit(self.floor), length)


OUTLINE = Tolerance(1e-8, absolute=True)
CONTRACT = Tolerance(1e-6, floor=1.0)
ROUTER = Tolerance(1e-7)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def is_finite(c: Column) -> Column:
    """True for real numbers only: Spark orders NaN above infinity, so both are tested."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def norm(dx: Column, dy: Column) -> Column:
    """Vector length; several times cheaper than ``hypot``, whose range no drawing needs."""
    return F.sqrt(dx * dx + dy * dy)


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return norm(bx - ax, by - ay)


def cross(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    return ux * vy - uy * vx


def _between(p: Column, a: Column, b: Column, eps: float) -> Column:
    return (p >= F.least(a, b) - eps) & (p <= F.greatest(a, b) + eps)


def on_segment(px, py, ax, ay, bx, by, tol: Tolerance = OUTLINE) -> Column:
    """``p`` lies on ab; the cheap box test runs first, and a zero-length ab needs no more than that
    box (its corners are within sqrt(2) tolerances of the point)."""
    boxed = _between(px, ax, bx, tol.eps) & _between(py, ay, by, tol.eps)
    near_line = F.abs(cross(bx - ax, by - ay, px - ax, py - ay)) <= tol.band(dist(ax, ay, bx, by))
    return boxed & near_line


def segments_touch(ax, ay, bx, by, cx, cy, dx, dy, tol: Tolerance = CONTRACT) -> Column:
    """Any contact of segments ab and cd: crossing, touching end or collinear overlap."""

    def side(ox, oy, tx, ty, px, py):
        return cross(tx - ox, ty - oy, px - ox, py - oy)

    proper = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (
        side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0
    )
    return (
        proper
        | on_segment(ax, ay, cx, cy, dx, dy, tol)
        | on_segment(bx, by, cx, cy, dx, dy, tol)
        | on_segment(cx, cy, ax, ay, bx, by, tol)
        | on_segment(dx, dy, ax, ay, bx, by, tol)
    )


def touching(ax, ay, bx, by, cx, cy, dx, dy, tol: Tolerance = CONTRACT) -> np.ndarray:
    """``segments_touch`` of whole arrays, by the same operations: as one expression it outgrows what the JVM compiles."""

    def side(ox, oy, tx, ty, px, py):
        return (tx - ox) * (py - oy) - (ty - oy) * (px - ox)

    def on(px, py, ax, ay, bx, by):
        boxed = (px >= np.minimum(ax, bx) - tol.eps) & (px <= np.maximum(ax, bx) + tol.eps)
        boxed &= (py >= np.minimum(ay, by) - tol.eps) & (py <= np.maximum(ay, by) + tol.eps)
        vx, vy = bx - ax, by - ay
        band = tol.eps if tol.absolute else tol.eps * np.maximum(tol.floor, np.sqrt(vx * vx + vy * vy))
        return boxed & (np.abs(vx * (py - ay) - vy * (px - ax)) <= band)

    proper = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    ends = on(ax, ay, cx, cy, dx, dy) | on(bx, by, cx, cy, dx, dy) | on(cx, cy, ax, ay, bx, by) | on(dx, dy, ax, ay, bx, by)
    return proper | ends


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    vx, vy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * vx + (py - ay) * vy, vx * vx + vy * vy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return norm(px - (ax + t * vx), py - (ay + t * vy))


def segment_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    ends = F.least(
        point_segment_distance(ax, ay, cx, cy, dx, dy),
        point_segment_distance(bx, by, cx, cy, dx, dy),
        point_segment_distance(cx, cy, ax, ay, bx, by),
        point_segment_distance(dx, dy, ax, ay, bx, by),
    )
    return F.when(segments_touch(ax, ay, bx, by, cx, cy, dx, dy, Tolerance(0.0)), F.lit(0.0)).otherwise(ends)


@F.pandas_udf(DoubleType())
def segment_gaps(
    ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series
) -> pd.Series:
    """``segment_distance`` of whole batches, by the same operations: as one expression it outgrows what the JVM compiles.

    All coordinates are real numbers."""
    ax, ay, bx, by, cx, cy, dx, dy = (c.to_numpy(float) for c in (ax, ay, bx, by, cx, cy, dx, dy))

    def side(ox, oy, tx, ty, px, py):
        return (tx - ox) * (py - oy) - (ty - oy) * (px - ox)

    def reach(px, py, ax, ay, bx, by):
        vx, vy, wx, wy = bx - ax, by - ay, px - ax, py - ay
        square = vx * vx + vy * vy
        t = np.divide(wx * vx + wy * vy, square, out=np.zeros_like(square), where=square != 0).clip(0.0, 1.0)
        ex, ey = px - (ax + t * vx), py - (ay + t * vy)
        boxed = (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
        return np.where(boxed & (vx * wy - vy * wx == 0), 0.0, np.sqrt(ex * ex + ey * ey))

    proper = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    ends = np.minimum(reach(ax, ay, cx, cy, dx, dy), reach(bx, by, cx, cy, dx, dy))
    ends = np.minimum(ends, np.minimum(reach(cx, cy, ax, ay, bx, by), reach(dx, dy, ax, ay, bx, by)))
    return pd.Series(np.where(proper, 0.0, ends))


def ring_sides(ring: Column) -> Column:
    """``ARRAY<STRUCT<a, b>>``: consecutive vertices with the closing side."""
    rotated = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), rotated.alias("b"))


def path_sides(path: Column) -> Column:
    """``ARRAY<STRUCT<a, b>>`` of an open polyline; empty below two points."""
    count = F.greatest(F.size(path) - 1, F.lit(0))
    return F.arrays_zip(F.slice(path, F.lit(1), count).alias("a"), F.slice(path, F.lit(2), count).alias("b"))


def polyline_length(path: Column) -> Column:
    """Length of a polyline array; NaN as soon as one coordinate is not a real number."""
    real = F.forall(path, lambda p: is_finite(p["x"]) & is_finite(p["y"]))
    total = F.aggregate(
        path_sides(path),
        F.lit(0.0),
        lambda acc, s: acc + dist(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]),
    )
    return F.when(real, total).otherwise(F.lit(float("nan")))


def ring_area(ring: Column) -> Column:
    """Signed area; positive for clockwise order on screen."""
    return F.aggregate(
        ring_sides(ring),
        F.lit(0.0),
        lambda acc, s: acc + cross(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]),
    ) / F.lit(2.0)


def ring_contains(ring: Column, px: Column, py: Column, tol: Tolerance = OUTLINE) -> Column:
    """Boundary-inclusive containment by ray parity; the slope test is cross-multiplied."""
    return sides_contain(ring_sides(ring), px, py, tol)


def sides_contain(sides: Column, px: Column, py: Column, tol: Tolerance = OUTLINE) -> Column:
    """Containment against prepared sides, so a joined outline is unrolled once per polygon, not per pair."""
    boundary = F.exists(
        sides, lambda s: on_segment(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], tol)
    )

    def crosses(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        straddles = (ay > py) != (by > py)
        lead = (px - ax) * (by - ay) - (bx - ax) * (py - ay)
        return straddles & F.when(by > ay, lead < 0).otherwise(lead > 0)

    parity = F.size(F.filter(sides, crosses)) % 2 == 1
    real = is_finite(px) & is_finite(py)
    return F.coalesce(real & (F.size(sides) >= 3) & (parity | boundary), F.lit(False))


def clean_ring(ring: Column, eps: float) -> Column:
    """Drop a closing vertex that repeats the first one."""
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    closed = (F.size(ring) > 1) & (dist(first["x"], first["y"], last["x"], last["y"]) < eps)
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def round_half_even(x: Column, digits: int) -> Column:
    """Correctly rounded half-even decimal rounding of the exact binary value.

    ``bround`` rounds the shortest decimal text, which turns near-ties into ties; here the exact
    error of the scaling product (split multiplication) settles which side of the tie ``x`` is on.
    """
    scale = float(10**digits)
    splitter = F.lit(134217729.0)

    def split(v: Column):
        c = splitter * v
        high = c - (c - v)
        return high, v - high

    s = F.lit(scale)
    product = x * s
    xh, xl = split(x)
    sh, sl = split(s)
    error = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    floor = F.floor(product).cast("double")
    tie = (product - floor) == 0.5
    rounded = (
        F.when(tie & (error > 0), floor + 1)
        .when(tie & (error < 0), floor)
        .otherwise(F.rint(product))
    )
    safe = F.abs(product) < F.lit(2.0**52)
    return F.when(safe, rounded / s).otherwise(x)
