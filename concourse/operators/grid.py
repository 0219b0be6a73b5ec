"""Grid graphs over domains: cells, clearance, links, endpoint candidates.

A domain is one row per ring (domain_id, ring and its box): outlines of all its parts and of all holes, in any order.
Rings may touch but not cross, as in the border of a polygon; a point is inside if it has an odd number of sides on
one hand.  Rings of fewer than three points are no border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concourse.functions import geometry as g
from concourse.operators.slabs import inside
from concourse.operators.spatial import NEAR_DOMAIN, SEG, WALL, boundary, boxes_touch, few_sides, indexed, nearest_sides, segment_hits, snap_to_grid, within_domain
from concourse.session import cut, partitions, sized

# Grid step, clearance penalty and door offsets.
STEP = 3.0
PENALTY, CLEARANCE_FLOOR = 8.0, 0.25
DOOR_OFFSETS = (2, 4, 6, 10, 15, 22, 30)


def domain_sides(domains: DataFrame) -> DataFrame:
    """Sides (domain_id, cx, cy, dx, dy) of all rings of three points and more."""
    return boundary(domains.filter(F.size("ring") >= 3), "domain_id").drop("side_ord")


def grid_cells(domains: DataFrame, step: float = STEP) -> DataFrame:
    """Lattice points strictly inside each domain: domain_id, ix, iy, x, y.

    Scanline fill: every side gives its crossing with each lattice row, the cells between the first and second, third and
    fourth ... crossing of a row are inside, and the cells that lie on a side are taken out.  The work follows the cells
    and the border, not their product.
    """
    size, eps = F.lit(float(step)), g.OUTLINE.eps
    sides = domain_sides(domains)
    row = lambda y: y / size
    # Half-open in y, so that a vertex on a row is crossed once; horizontal sides cross nothing.
    low, high = F.least("cy", "dy"), F.greatest("cy", "dy")
    first, last = F.ceil(row(low)).cast("long"), (F.ceil(row(high)) - 1).cast("long")
    crossed = sides.filter(first <= last).withColumn("iy", F.explode(F.sequence(first, last)))
    x = F.col("cx") + (F.col("iy") * size - F.col("cy")) * F.try_divide(F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy"))
    along = Window.partitionBy("domain_id", "iy").orderBy("x")
    spans = crossed.select("domain_id", "iy", x.alias("x"))
    # Few bytes of crossings become many cells: their rows stay dealt to all slices instead of being put together by size.
    spans = spans.repartition(partitions(spans), "domain_id", "iy")
    spans = spans.withColumns({"nth": F.row_number().over(along), "to": F.lead("x").over(along)}).filter("nth % 2 = 1 and to is not null")
    left, right = F.ceil(row(F.col("x") - eps)).cast("long"), F.floor(row(F.col("to") + eps)).cast("long")
    filled = spans.filter(left <= right).select("domain_id", F.explode(F.sequence(left, right)).alias("ix"), "iy").distinct()
    on_border = _border_cells(sides, step, eps)
    cells = filled.join(on_border, ["domain_id", "ix", "iy"], "left_anti")
    return cells.withColumns({"x": F.col("ix") * size, "y": F.col("iy") * size})


def _border_cells(sides: DataFrame, step: float, eps: float) -> DataFrame:
    """Lattice points on the sides: on each row of a side the few around its crossing, and all along a horizontal one."""
    size = F.lit(float(step))
    rows = F.sequence(F.ceil((F.least("cy", "dy") - eps) / size).cast("long"), F.floor((F.greatest("cy", "dy") + eps) / size).cast("long"))
    some = F.ceil((F.least("cy", "dy") - eps) / size) <= F.floor((F.greatest("cy", "dy") + eps) / size)
    met = sides.filter(some).withColumn("iy", F.explode(rows))
    tall = F.abs(F.col("dy") - F.col("cy")) > eps
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("iy") * size - F.col("cy"), F.col("dy") - F.col("cy"))))
    x = F.col("cx") + share * (F.col("dx") - F.col("cx"))
    # A flat side stays near a row over a stretch; a tall one near its crossing, as wide as the tolerance leans along it.
    lean = F.abs(F.try_divide(F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy"))) * eps + eps
    low = F.when(tall, x - lean).otherwise(F.least("cx", "dx") - eps)
    high = F.when(tall, x + lean).otherwise(F.greatest("cx", "dx") + eps)
    first, last = F.ceil(low / size).cast("long"), F.floor(high / size).cast("long")
    cells = met.withColumns({"_from": first, "_to": last}).filter("_from <= _to").withColumn("ix", F.explode(F.sequence("_from", "_to")))
    on = g.on_segment(F.col("ix") * size, F.col("iy") * size, F.col("cx"), F.col("cy"), F.col("dx"), F.col("dy"), g.OUTLINE)
    return cells.filter(on).select("domain_id", "ix", "iy").distinct()


def clearance(cells: DataFrame, domains: DataFrame, step: float = STEP) -> DataFrame:
    """Distance of every cell to its domain's border, holes included; each cell meets the few sides of its domain, or of many
    those within a growing reach."""
    sides = domain_sides(domains)
    few, many = few_sides(sides)
    gap = g.point_segment_distance(F.col("x").cast("double"), F.col("y").cast("double"), *[F.col(c) for c in WALL])
    real = F.col("x") * 0 + F.col("y") * 0 == 0
    # The sides of a cell follow each other, so they fold into one row before the cells are dealt by their keys.
    near = cells.filter(real).join(few, "domain_id").groupBy(*cells.columns).agg(F.min(gap).alias("clearance"))
    if many.isEmpty():
        return near.select(*cells.columns, "clearance")
    named = cut(cells.join(many, "domain_id", "left_semi").withColumn("_cell", F.concat_ws("/", F.col("domain_id").cast("string"), "ix", "iy")))
    gaps = nearest_sides(named, sides, "_cell", 2.0 * step)
    far = named.join(gaps.withColumnRenamed("gap", "clearance"), "_cell").select(*cells.columns, "clearance")
    return near.select(*far.columns).unionByName(far)


def grid_links(cells: DataFrame, domains: DataFrame, step: float = STEP) -> DataFrame:
    """Undirected eight-neighbour links inside the domain with length and clearance-penalised cost.

    cells carry ``clearance``.  Four offsets produce each link once.  Both ends are inside, so only links that meet a side
    can leave the domain; those are cut where they do and tested.
    """
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))])
    asked = cells.withColumn("o", F.explode(offsets)).select(
        "domain_id",
        F.col("ix").alias("ix0"),
        F.col("iy").alias("iy0"),
        F.col("x").alias("ax"),
        F.col("y").alias("ay"),
        F.col("clearance").alias("c0"),
        (F.col("ix") + F.col("o.dx")).alias("ix"),
        (F.col("iy") + F.col("o.dy")).alias("iy"),
    )
    links = asked.join(cells.withColumnsRenamed({"x": "bx", "y": "by_"}), ["domain_id", "ix", "iy"])
    links = links.withColumn("length", g.norm(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")))
    # A link no longer than an end's clearance cannot leave the domain; only the others, along the border, get a name.
    roomy = F.greatest("c0", "clearance") >= F.col("length")
    name = F.concat_ws("/", F.col("domain_id").cast("string"), "ix0", "iy0", "ix", "iy")
    close = links.filter(~roomy).select("domain_id", "ix0", "iy0", "ix", "iy", *SEG)
    sides = domain_sides(domains)
    few, many = few_sides(sides)
    near = close.join(few, "domain_id")
    met = near.filter(boxes_touch(g.ROUTER.eps)).filter(g.segments_touch(*[F.col(c).cast("double") for c in SEG + WALL], g.ROUTER))
    doubtful = met.select(*close.columns).distinct().withColumn("_link", name)
    if not many.isEmpty():
        along = cut(close.join(many, "domain_id", "left_semi").withColumn("_link", name))
        touched = segment_hits(along, sides, g.ROUTER, float(step), ["domain_id"]).select("_link").distinct()
        doubtful = doubtful.unionByName(along.join(touched, "_link", "left_semi"))
    doubtful = cut(doubtful)
    left = doubtful.join(within_domain(doubtful, domains, "_link", g.ROUTER, float(step)), "_link", "left_anti")
    tight = F.greatest(F.least("c0", "clearance"), F.lit(CLEARANCE_FLOOR))
    kept = links.join(sized(left.select("domain_id", "ix0", "iy0", "ix", "iy")), ["domain_id", "ix0", "iy0", "ix", "iy"], "left_anti")
    return kept.select(
        "domain_id",
        "ix0",
        "iy0",
        F.col("ix").alias("ix1"),
        F.col("iy").alias("iy1"),
        "length",
        (F.col("length") * (F.lit(1.0) + F.lit(PENALTY) / tight)).alias("cost"),
    )


def endpoint_candidates(doors: DataFrame, distances: Sequence[int] = DOOR_OFFSETS, keep: Sequence[str] = ()) -> DataFrame:
    """Approach points on both sides of each door along its normal: door_id, offset, x, y and the columns ``keep``.

    A room without a door segment has its fallback point (``fx``, ``fy``: a given point or the label) at no distance.
    """
    length = g.dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"))
    nx = F.try_divide(-(F.col("by_") - F.col("ay")), length)
    ny = F.try_divide(F.col("bx") - F.col("ax"), length)
    offsets = F.array(*[F.lit(float(v * s)) for v in distances for s in (1, -1)])
    spread = doors.filter(length > 0).withColumn("offset", F.explode(offsets))
    approaches = spread.select(
        "door_id",
        "offset",
        ((F.col("ax") + F.col("bx")) / 2 + nx * F.col("offset")).alias("x"),
        ((F.col("ay") + F.col("by_")) / 2 + ny * F.col("offset")).alias("y"),
        *keep,
    )
    if "fx" not in doors.columns:
        return approaches
    bare = doors.filter(~F.coalesce(length > 0, F.lit(False)) & F.col("fx").isNotNull() & F.col("fy").isNotNull())
    return approaches.union(bare.select("door_id", F.lit(0.0), F.col("fx").cast("double"), F.col("fy").cast("double"), *keep))


def choose_endpoints(doors: DataFrame, domains: DataFrame, vertices: DataFrame, step: float, base: float = 1.0) -> DataFrame:
    """Best approach per door: inside the domain and snapped to the nearest grid vertex that it sees, if a path leads there;
    least by (door distance, path distance, point, vertex).

    doors: door_id, domain_id, segment and fallback point; vertices: ix, iy, path_distance.  A door without an option is a
    row with ``found`` false and no point.  The door distance decides first, so only doors without an option at the least
    distance (or at their fallback point) go on to the others.
    """
    doors, vertices = cut(doors), sized(vertices)
    index = indexed(domains, NEAR_DOMAIN.eps)
    paths = vertices.filter("path_distance is not null")
    point, of = ["point_id", "domain_id", "x", "y"], ["door_id", "offset"]
    rank = F.struct(F.abs("offset").alias("door_distance"), "path_distance", F.col("x"), F.col("y"), F.col("iy"), F.col("ix"))
    name = F.concat_ws("@", F.col("door_id").cast("string"), F.col("offset").cast("string"))
    found, waiting = None, doors
    for distances in (DOOR_OFFSETS[:1], DOOR_OFFSETS[1:]):
        candidates = endpoint_candidates(waiting, distances, ["domain_id"]).withColumn("point_id", name).join(index.frames, "domain_id")
        covered = inside(candidates, index.slabs, ["domain_id"], [*point, *of], "x", "y")
        snapped = snap_to_grid(covered, vertices.select("ix", "iy"), step, domains=index, base=base, carry=["x", "y", *of], held=True)
        best = cut(snapped.join(paths, ["ix", "iy"]).groupBy("door_id").agg(F.min(rank).alias("b")))
        found = best if found is None else found.unionByName(best)
        # The fallback points are settled with the first distance.
        waiting = cut(waiting.join(best, "door_id", "left_anti").drop("fx", "fy"))
        if waiting.isEmpty():
            break
    return doors.select("door_id").join(found, "door_id", "left").select("door_id", F.col("b").isNotNull().alias("found"), "b.*")
