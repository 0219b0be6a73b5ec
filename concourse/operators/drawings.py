"""Extracted drawing text and linework: filters, projections and door evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions.geometry import cross, dist

# Layer names, number lists, tags and limits of the drawing set.
WALL_LAYERS = (
    "A-WALL",
    "A-WALL-02",
    "A-CONC",
    "A-GYPSUM BOARD",
    "A-CLADDING-STONE",
    "A-GLAZING-6700",
    "A-INT-GLAZ-01",
    "02-XA-B03-GROUND FLOOR SKIN$0$A-WALL",
)
DOOR_MARK, DOOR_STEP_LAYER = "DOOR", "A-DOOR-STEP"
CATEGORY_NUMBERS = {
    "circulation": [1, 2, 3, 4, 8, 9, 14, 17, 23, 31, 32, 53, 54],
    "restroom": [12, 13, 41, 42],
    "laboratory": [43, 45, 46, 47, 50],
    "office": [15, 22, 25, 30, 38, 44],
    "service": [6, 10, 11, 19, 20, 21, 34, 35, 36, 37, 39, 40, 48, 49, 51, 52],
}
TAG_NUMBERS = {"007": 8, "009": 17, "045": 24}
SHADED_BELOW = 2.9
SWING_RADIUS = (10.0, 65.0)
SWING_SLACK = 2.0
SHORTEST_LINE = 0.001
CURVE_STEPS = 24


def boxes_touch(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Boxes (x0, y0, x1, y1) share at least a boundary point."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def box_within(inner: Sequence[Column], outer: Sequence[Column]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def box_of(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")]


def keep_paths(
    paths: DataFrame, layers: Sequence[str], crop: Sequence[float], corner_only: bool = False
) -> DataFrame:
    """Allow-listed layers whose box touches the crop (or whose first corner lies in it)."""
    edge = [F.lit(v) for v in crop]
    x0, y0, _, _ = box_of()
    inside = x0.between(edge[0], edge[2]) & y0.between(edge[1], edge[3]) if corner_only else boxes_touch(box_of(), edge)
    return paths.filter(F.col("layer").isin(list(layers)) & inside)


def drop_excluded(paths: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop paths lying wholly inside an exclusion box of their own layer."""
    ex = exclusions.select(F.col("layer").alias("ex_layer"), *[F.col(c).alias("ex_" + c) for c in ("x0", "y0", "x1", "y1")])
    cond = (F.col("layer") == F.col("ex_layer")) & box_within(box_of(), box_of("ex_"))
    return paths.join(ex, cond, "left_anti")


def affine(x: Column, y: Column, matrix: Sequence[float | Column]) -> tuple[Column, Column]:
    """Row-vector transform ``(x, y, 1) * [a b; c d; e f]``."""
    a, b, c, d, e, f = [F.lit(v) if not isinstance(v, Column) else v for v in matrix]
    return x * a + y * c + e, x * b + y * d + f


def fill_class(fill: Column) -> Column:
    """Shaded when a fill exists and its channels sum below the near-white limit."""
    total = F.aggregate(fill, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(fill.isNotNull() & (F.size(fill) > 0) & (total < SHADED_BELOW), "shaded").otherwise("none")


def category_of(number: Column) -> Column:
    out = F.lit("other")
    for name, numbers in reversed(CATEGORY_NUMBERS.items()):
        out = F.when(number.isin(numbers), name).otherwise(out)
    return out


def label_number(tag: Column) -> Column:
    """Schedule number of a plan tag: the known exceptions, else the tag read as a number."""
    out = F.expr("cast(null as int)")
    for known, number in TAG_NUMBERS.items():
        out = F.when(tag == known, F.lit(number)).otherwise(out)
    return F.coalesce(out, tag.try_cast("int"))


def alias_set(*variants: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array(*variants)))


def layer_class(layer: Column) -> Column:
    door = layer.contains(DOOR_MARK) & (layer != DOOR_STEP_LAYER)
    return F.when(layer.isin(list(WALL_LAYERS)), "wall").when(door, "door").otherwise("other")


def sample_points(kind: Column, points: Column, steps: int = CURVE_STEPS) -> Column:
    """Polyline of an item: cubics sampled at ``steps + 1`` parameters, rectangles and quads closed."""

    def at(i: Column) -> Column:
        t = i / F.lit(float(steps))
        s = F.lit(1.0) - t
        weights = [s * s * s, F.lit(3.0) * t * s * s, F.lit(3.0) * t * t * s, t * t * t]

        def mix(axis: str) -> Column:
            parts = [w * F.get(points, F.lit(k))[axis] for k, w in enumerate(weights)]
            return parts[0] + parts[1] + parts[2] + parts[3]

        return F.struct(mix("x").alias("x"), mix("y").alias("y"))

    curve = F.transform(F.sequence(F.lit(0), F.lit(steps)), at)
    closed = F.concat(points, F.slice(points, 1, 1))
    return F.when(kind == "cubic", curve).when(kind.isin("rect", "quad"), closed).otherwise(points)


def swing_center(p: Sequence[tuple[Column, Column]]) -> dict[str, Column]:
    """Hinge, radius and radius mismatch of a quarter-circle cubic from the normals at its ends."""
    (ax, ay), (c1x, c1y), (c2x, c2y), (bx, by) = p
    nax, nay = -(c1y - ay), c1x - ax
    nbx, nby = -(by - c2y), bx - c2x
    det = cross(nax, nay, nbx, nby)
    t = F.try_divide(cross(bx - ax, by - ay, nbx, nby), F.when(F.abs(det) >= 0.001, det))
    hx, hy = ax + t * nax, ay + t * nay
    radius = dist(hx, hy, ax, ay)
    return {"hinge_x": hx, "hinge_y": hy, "radius": radius, "mismatch": F.abs(dist(hx, hy, bx, by) - radius)}


def usable_swing(radius: Column, mismatch: Column) -> Column:
    """A hinge was found, the radius is a door's, and both ends agree on it."""
    ok = radius.between(*SWING_RADIUS) & (mismatch <= SWING_SLACK)
    return F.coalesce(ok, F.lit(False))


def usable_line(length: Column) -> Column:
    return length >= SHORTEST_LINE


def seam_window(
    crop: Sequence[Column], shift: Sequence[Column], view: Sequence[Column], seam: Column, side: Column
) -> dict[str, Column]:
    """Visible window of one sheet: its shifted crop cut at the seam and at the drawing frame."""
    dx, dy = shift
    frame_right = view[0] + view[2]
    left = F.greatest(crop[0] + dx, F.when(side == "right", seam).otherwise(view[0]))
    right = F.least(crop[2] + dx, F.when(side == "left", seam).otherwise(frame_right))
    return {"left": left, "top": crop[1] + dy, "right": right, "bottom": crop[3] + dy}


def id_number(path_id: Column) -> Column:
    """Number after the last dash of a path id."""
    return F.substring_index(path_id, "-", -1).try_cast("long")


def id_subset(paths: DataFrame, ids: DataFrame, shift: Sequence[float]) -> DataFrame:
    """Paths whose id number is listed, moved into the shared frame."""
    dx, dy = shift
    chosen = paths.withColumn("number", id_number(F.col("path_id"))).join(ids.select("number"), "number", "left_semi")
    moved = {c: F.col(c) + F.lit(d) for c, d in (("x0", dx), ("y0", dy), ("x1", dx), ("y1", dy))}
    return chosen.withColumns(moved)


def provenance(sources: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Evidence array of (source, note, status) triples, each citing page 1."""
    return F.array(
        *[
            F.struct(s.alias("source"), F.lit(1).alias("page"), n.alias("note"), st.alias("status"))
            for s, n, st in sources
        ]
    )


def matched_leaves(swings: DataFrame, lines: DataFrame, base: float = 8.0) -> DataFrame:
    """Door leaf per swing arc: same source, leaf as long as the radius, one end at the hinge, the
    other at an arc end; the first leaf in drawing order wins, the arc's start tried before its end.

    swings: swing_id, source_id, ax, ay, bx, by, hinge_x, hinge_y, radius;
    lines: leaf_id, leaf_ord, source_id, lx0, ly0, lx1, ly1.
    """
    from concourse.operators.ordered import first_per
    from concourse.operators.spatial import bbox_join

    reach = SWING_SLACK
    ends = F.array(
        F.struct(F.col("lx0").alias("ex"), F.col("ly0").alias("ey")),
        F.struct(F.col("lx1").alias("ex"), F.col("ly1").alias("ey")),
    )
    leaf_ends = lines.withColumn("_end", F.explode(ends)).select(*lines.columns, "_end.*")
    near = bbox_join(
        swings,
        leaf_ends,
        [F.col("hinge_x") - reach, F.col("hinge_y") - reach, F.col("hinge_x") + reach, F.col("hinge_y") + reach],
        [F.col("ex"), F.col("ey"), F.col("ex"), F.col("ey")],
        base=base,
        on=["source_id"],
    )
    lx0, ly0, lx1, ly1 = (F.col(c) for c in ("lx0", "ly0", "lx1", "ly1"))
    length = dist(lx0, ly0, lx1, ly1)

    def end_gap(x: str, y: str) -> Column:
        return F.least(dist(F.col(x), F.col(y), lx0, ly0), dist(F.col(x), F.col(y), lx1, ly1))

    fits = near.filter(
        (F.abs(length - F.col("radius")) <= SWING_SLACK) & (end_gap("hinge_x", "hinge_y") <= SWING_SLACK)
    )
    start, end = end_gap("ax", "ay") < SWING_SLACK, end_gap("bx", "by") < SWING_SLACK
    tried = fits.withColumn("closes_at", F.when(start, "end").when(end, "start")).filter("closes_at is not null")
    return first_per(
        tried.select("swing_id", "leaf_ord", "leaf_id", "closes_at"), ["swing_id"], ["leaf_ord", "leaf_id"]
    ).select("swing_id", "leaf_id", "closes_at")
