"""Sides of outlines as rows, indexed by horizontal slabs.

The height of an outline is cut into slabs on several levels, each level halving the ones before, down to about
``SLAB_SIDES`` sides for a slab.  A side lies on the finest level whose slabs are no lower than itself, so it takes at most
three rows there, and a point looks at one slab of every level.  Points meet sides by an equi-join on (outline, level,
slab); whether a point is inside is the parity of a sum over the sides it met.  No row holds the sides of an outline.

An outline is named by ``key`` columns; several rings under one name (parts and holes) are one outline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.session import held

SLAB_SIDES = 8
FRAME = ("frame_low", "frame_high", "frame_levels")


def real_box(box: Sequence[Column]) -> Column:
    """All four limits are real numbers: anything else times zero is not zero."""
    return box[0] * 0 + box[1] * 0 + box[2] * 0 + box[3] * 0 == 0


def framed(outlines: DataFrame, key: Sequence[str], several: bool = False) -> DataFrame:
    """Rings with the height of their outline and the levels of its slabs; ``several``: an outline may have many rings.
    Rings of fewer than three points or without a real box are left out."""
    rings = outlines.filter((F.size("ring") >= 3) & real_box([F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]))
    low, high, sides = F.col("min_y"), F.col("max_y"), F.size("ring")
    levels = lambda n: F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(SLAB_SIDES))))).cast("int")
    if not several:
        return rings.withColumns({"frame_low": low, "frame_high": high, "frame_levels": levels(sides)})
    of = rings.groupBy(*key).agg(F.min(low).alias("frame_low"), F.max(high).alias("frame_high"), levels(F.sum(sides)).alias("frame_levels"))
    return rings.join(of, list(key))


def _width(level: Column) -> Column:
    return F.greatest(F.col("frame_high") - F.col("frame_low"), F.lit(1e-9)) / F.pow(F.lit(2.0), level)


def _slab(y: Column, level: Column) -> Column:
    """The slab of this level that holds ``y``; beyond the outline the outermost one."""
    top = F.pow(F.lit(2.0), level) - 1
    return F.greatest(F.lit(0.0), F.least(top, F.floor((y - F.col("frame_low")) / _width(level)).cast("double"))).cast("long")


def side_slabs(rings: DataFrame, key: Sequence[str], eps: float) -> DataFrame:
    """key, _level, _slab, cx, cy, dx, dy: every side of the framed rings in the slabs it reaches."""
    sides = rings.select(*key, *FRAME, F.explode(g.ring_sides(F.col("ring"))).alias("s")).select(
        *key, *FRAME, F.col("s.a.x").alias("cx"), F.col("s.a.y").alias("cy"), F.col("s.b.x").alias("dx"), F.col("s.b.y").alias("dy")
    )
    low, high = F.least("cy", "dy") - eps, F.greatest("cy", "dy") + eps
    fits = F.floor(F.log2(_width(F.lit(0)) / F.greatest(high - low, F.lit(1e-300))))
    sides = sides.withColumn("_level", F.greatest(F.lit(0), F.least(F.col("frame_levels"), fits)).cast("int"))
    level = F.col("_level")
    return sides.withColumn("_slab", F.explode(F.sequence(_slab(low, level), _slab(high, level)))).drop(*FRAME)


def judged(
    points: DataFrame, slabs: DataFrame, key: Sequence[str], keep: Sequence[str], x: str, y: str, tol: g.Tolerance = g.OUTLINE, **more: Column
) -> DataFrame:
    """``keep`` of the points that met a side, with ``odd`` (inside by parity), ``on`` (on a side) and the greatest value of
    ``more`` over the sides they lie on.  Points carry the frame of the outline they name and meet its sides only; rows that
    are equal in ``keep`` are one point."""
    met = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("frame_levels"))))
    met = met.withColumn("_slab", _slab(F.col(y), F.col("_level"))).drop(*FRAME).join(held(slabs), [*key, "_level", "_slab"])
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    cx, cy, dx, dy = (F.col(c) for c in ("cx", "cy", "dx", "dy"))
    ahead = (px - cx) * (dy - cy) - (dx - cx) * (py - cy)
    crossed = ((cy > py) != (dy > py)) & F.when(dy > cy, ahead < 0).otherwise(ahead > 0)
    on = F.coalesce(g.on_segment(px, py, cx, cy, dx, dy, tol), F.lit(False))
    sums = [(F.count_if(crossed) % 2 == 1).alias("odd"), F.max(on).alias("on")]
    return met.groupBy(*keep).agg(*sums, *[F.max(F.when(on, v)).alias(name) for name, v in more.items()])


def inside(
    points: DataFrame, slabs: DataFrame, key: Sequence[str], keep: Sequence[str], x: str, y: str, tol: g.Tolerance = g.OUTLINE, border: bool = True
) -> DataFrame:
    """The ``points`` (columns ``keep``) that lie in the outline they name; ``border``: points on a side count too."""
    found = judged(points, slabs, key, keep, x, y, tol)
    return found.filter(F.col("odd") | F.col("on") if border else F.col("odd") & ~F.col("on")).select(*keep)


def contacts(pairs: DataFrame, tol: g.Tolerance = g.ROUTER) -> DataFrame:
    """The fractions ``t`` along segment ab (ax..by_) where side cd (cx..dy) of a pair meets it, one row each.

    Seen from ab, an end of cd has a place along it and a height above it.  A side whose ends both lie within ``eps`` of
    the line shares the stretch between their places and gives its two ends; any other one meets the line where its height
    is zero, or at the end that is within ``eps``.  Only places within ``eps`` of ab count.  The steps are columns of their
    own, so that each of them is computed once.
    """
    ax, ay, bx, by, cx, cy, dx, dy = (F.col(c).cast("double") for c in ("ax", "ay", "bx", "by_", "cx", "cy", "dx", "dy"))
    eps, zero, one = F.lit(tol.eps), F.lit(0.0), F.lit(1.0)
    own = list(pairs.columns)
    seen = pairs.withColumn("_len", g.dist(ax, ay, bx, by)).withColumns({"_ux": F.try_divide(bx - ax, "_len"), "_uy": F.try_divide(by - ay, "_len")})
    ux, uy = F.col("_ux"), F.col("_uy")
    seen = seen.withColumns({
        "_cp": ux * (cx - ax) + uy * (cy - ay), "_ch": g.cross(ux, uy, cx - ax, cy - ay),
        "_dp": ux * (dx - ax) + uy * (dy - ay), "_dh": g.cross(ux, uy, dx - ax, dy - ay),
    })
    share = F.greatest(zero, F.least(one, F.coalesce(F.try_divide(F.col("_ch"), F.col("_ch") - F.col("_dh")), zero)))
    near = F.least(F.abs("_ch"), F.abs("_dh")) <= eps
    seen = seen.withColumns({
        "_both": F.greatest(F.abs("_ch"), F.abs("_dh")) <= eps,
        "_meets": near | (F.col("_ch") * F.col("_dh") < 0),
        "_at": F.col("_cp") + share * (F.col("_dp") - F.col("_cp")),
    })
    first = F.when(F.col("_both"), F.least("_cp", "_dp")).when(F.col("_meets"), F.col("_at"))
    last = F.when(F.col("_both"), F.greatest("_cp", "_dp")).when(F.col("_meets"), F.col("_at"))
    seen = seen.withColumns({"_first": first, "_last": last})
    spot = (F.col("_len") == 0) & g.on_segment(ax, ay, cx, cy, dx, dy, tol)
    within = (F.col("_first") <= F.col("_len") + eps) & (F.col("_last") >= -eps)
    # A segment without length has no direction, so no places: it is met as a point.
    fraction = lambda c: F.coalesce(F.greatest(zero, F.least(one, F.try_divide(F.col(c), "_len"))), zero)
    # A filter would be pushed down through all these columns and compute them again; outer rows are dropped instead.
    places = F.when(F.coalesce(within, F.lit(False)) | spot, F.array_distinct(F.array(fraction("_first"), fraction("_last"))))
    return seen.withColumn("t", F.explode_outer(places)).filter("t is not null").select(*own, "t")
