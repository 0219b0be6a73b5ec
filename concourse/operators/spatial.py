"""Spatial joins by size-matched grid cells.

Every box takes the grid level whose cells are at least as large as itself, so it covers at most four
cells of its own level; a pair meets on the coarser of its two levels, in exactly one agreed cell.
The join is a plain equi-join on (level, cell), which Spark can shuffle, split when skewed and spill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concourse.functions import geometry as g
from concourse.operators.ordered import running_max
from concourse.operators.slabs import FRAME, contacts, framed, inside, judged, real_box, side_slabs
from concourse.session import FEW_ROWS, cut, held as looked_up, partitions, sized


def _level(box: Sequence[Column], base: float) -> Column:
    """Level of the box's size; far from the origin cells are no finer than the numbers there."""
    far = F.greatest(*[F.abs(c) for c in box]) * F.lit(2.0**-50)
    size = F.greatest(box[2] - box[0], box[3] - box[1], far, F.lit(base)) / F.lit(base)
    return F.coalesce(F.ceil(F.log2(size)).cast("int"), F.lit(0))


def _with_cells(df: DataFrame, levels: Column, own: Column, box: Sequence[Column], base: float) -> DataFrame:
    """One row per covered cell on the box's own level and on every coarser level of the other side."""
    spread = df.withColumn("_own", own)
    wanted = F.array_distinct(F.concat(F.array("_own"), F.coalesce(levels, F.array().cast("array<int>"))))
    spread = spread.withColumn("_level", F.explode(wanted)).filter("_level >= _own")
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("_level"))

    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))

    spread = spread.withColumn("_cx", F.explode(span(box[0], box[2])))
    return spread.withColumn("_cy", F.explode(span(box[1], box[3])))


#: Boxes of one group up to which each row of the other side looks at all of them: fewer than the cells it would take.
FEW_BOXES = 16


def bbox_join(
    left: DataFrame,
    right: DataFrame,
    left_box: Sequence[Column],
    right_box: Sequence[Column],
    base: float = 1.0,
    on: Sequence[str] = (),
    pad: float = 0.0,
    dealt: bool = False,
    whole: bool = False,
    matched: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame] | None = None,
) -> DataFrame:
    """All pairs whose boxes (x0, y0, x1, y1) touch once grown by ``pad``; column names must be disjoint
    apart from the equality columns ``on``.  ``base`` is the finest cell size worth having.  A box with a limit that is
    not a real number touches nothing.  Groups of ``on`` with few boxes on the right are joined as groups, the others by cells.
    ``dealt`` is for many boxes on both sides: their cells are dealt to all slices, however few bytes they came from.
    ``whole``: the right side is known to be small; where groups meet it goes to every executor and the left side stays put.
    ``matched``, with ``dealt`` and without ``on``: makes the pairs from the cells of both sides itself."""
    names = ("x0", "y0", "x1", "y1")
    grow = (-pad, -pad, pad, pad)
    # No NULL among the limits: Spark then pushes no test of them down through the expressions they come from.
    limit = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    left = left.withColumns({f"_l{n}": limit(c) + d for n, c, d in zip(names, left_box, grow)})
    right = right.withColumns({f"_r{n}": limit(c) for n, c in zip(names, right_box)})
    lbox, rbox = [F.col(f"_l{n}") for n in names], [F.col(f"_r{n}") for n in names]
    left, right = left.filter(real_box(lbox)), right.filter(real_box(rbox))
    touch = (lbox[0] <= rbox[2]) & (rbox[0] <= lbox[2]) & (lbox[1] <= rbox[3]) & (rbox[1] <= lbox[3])
    own = {f"_{side}{n}" for side in "lr" for n in (*names, "own")} | {"_level", "_cx", "_cy", "_side"}
    direct: DataFrame | None = None
    if on:
        many = cut(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW_BOXES).select(*on))
        held = F.broadcast if whole else looked_up
        if many.isEmpty():
            direct = left.join(held(right), list(on)).filter(touch)
            return direct.select(*[c for c in direct.columns if c not in own])
        direct = left.join(held(right.join(many, list(on), "left_anti")), list(on)).filter(touch)
        left, right = left.join(many, list(on), "left_semi"), right.join(many, list(on), "left_semi")
    lown, rown = _level(lbox, base), _level(rbox, base)
    # Levels are logarithms of finite sizes, so each side's level list is one tiny scalar.
    llevels = left.agg(F.collect_set(lown)).scalar()
    rlevels = right.agg(F.collect_set(rown)).scalar()
    lcells = _with_cells(left, rlevels, lown, lbox, base).withColumnRenamed("_own", "_lown")
    rcells = _with_cells(right, llevels, rown, rbox, base).withColumnRenamed("_own", "_rown")
    cell = [*on, "_level", "_cx", "_cy"]
    if dealt:
        # A left box meets every right box in the cells of its own level, and in coarser cells only those of that level:
        # small boxes do not meet there once more to be dropped.
        cell.append("_side")
        lcells = lcells.withColumn("_side", F.when(F.col("_level") == F.col("_lown"), 0).otherwise(1))
        sides = F.when(F.col("_level") == F.col("_rown"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rcells = rcells.withColumn("_side", F.explode(sides))
        if matched is not None and not on:
            return matched(lcells, rcells, cell)
        lcells, rcells = (d.repartition(partitions(d), *cell) for d in (lcells, rcells))
        rcells = rcells.hint("merge")
    pairs = lcells.join(rcells, cell)
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("_level"))
    meet = (
        touch
        & (F.col("_level") == F.greatest("_lown", "_rown"))
        & (F.col("_cx") == F.floor(F.greatest(lbox[0], rbox[0]) / size))
        & (F.col("_cy") == F.floor(F.greatest(lbox[1], rbox[1]) / size))
    )
    keep = [c for c in pairs.columns if c not in own]
    met = pairs.filter(meet).select(*keep)
    return met if direct is None else met.unionByName(direct.select(*keep))


def ring_box(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Add min_x, min_y, max_x, max_y of the ring array."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return polygons.withColumns(
        {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}
    )


BOX = ("min_x", "min_y", "max_x", "max_y")


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    key: Sequence[str],
    tol: g.Tolerance = g.OUTLINE,
    base: float = 1.0,
    on: Sequence[str] = (),
    xy: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """Boundary-inclusive containment pairs; polygons carry ``ring`` and its box columns and are named by ``key`` and ``on``.

    Boxes give the candidate pairs; each meets only the sides in the slabs of its point.
    """
    name = [*on, *key]
    x, y = (F.col(c).cast("double") for c in xy)
    outlines = framed(polygons, name)
    near = bbox_join(points, outlines.drop("ring"), [x, y, x, y], [F.col(c) for c in BOX], base, on, pad=tol.eps)
    keep = [c for c in near.columns if c not in (*BOX, *FRAME)]
    return inside(near, side_slabs(outlines, name, tol.eps), name, keep, *xy, tol)


def _span(ax: str, ay: str, bx: str, by: str) -> list[Column]:
    return [F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)]


SEG = ("ax", "ay", "bx", "by_")
WALL = ("cx", "cy", "dx", "dy")


def boxes_touch(pad: float) -> Column:
    """The box of segment ax..by_, grown by ``pad``, touches that of wall cx..dy."""
    a, z = _span(*SEG), _span(*WALL)
    return (a[0] - pad <= z[2]) & (z[0] <= a[2] + pad) & (a[1] - pad <= z[3]) & (z[1] <= a[3] + pad)


def segment_hits(
    segments: DataFrame, walls: DataFrame, tol: g.Tolerance = g.CONTRACT, base: float = 1.0, on: Sequence[str] = (), dealt: bool = False,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs of segments (ax, ay, bx, by_) and walls (cx, cy, dx, dy) in any contact; with ``dealt`` only the columns ``keep``
    come back, all if there are none."""
    if dealt and not on:
        columns = [*segments.columns, *walls.columns] if keep is None else list(keep)
        made = lambda lcells, rcells, cell: _hits_by_cell(lcells, rcells, cell, columns, tol, base)
        return bbox_join(segments, walls, _span(*SEG), _span(*WALL), base, pad=tol.eps, dealt=True, matched=made)
    near = bbox_join(segments, walls, _span(*SEG), _span(*WALL), base, on, pad=tol.eps, dealt=dealt)
    cols = [F.col(c).cast("double") for c in SEG + WALL]
    return near.filter(g.segments_touch(*cols, tol))


#: Pairs of boxes compared at once, pairs handed on at once, and the pairs of a cell above which it is dealt to several tasks.
BLOCK, HANDED, CELL_PAIRS = 2**18, 2**16, 2**30


def _hits_by_cell(lcells: DataFrame, rcells: DataFrame, cell: Sequence[str], columns: Sequence[str], tol: g.Tolerance, base: float) -> DataFrame:
    """Pairs in contact from the cells of ``bbox_join``, compared by blocks of arrays, so a pair that does not touch is no row.

    The walls of a cell are held, its segments pass by in batches.  A cell with very many pairs deals its segments to several
    tasks, each of which holds its walls.
    """
    numbers = lambda cells: cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    many = numbers(lcells).join(numbers(rcells).withColumnRenamed("_n", "_m"), list(cell))
    many = many.withColumn("_parts", F.ceil(F.col("_n").cast("double") * F.col("_m") / CELL_PAIRS).cast("int")).filter("_parts > 1")
    many = cut(many.select(*cell, "_parts"))
    keep_l, keep_r = ([c for c in columns if c in cells.columns] for cells in (lcells, rcells))

    def rows(cells: DataFrame, left: bool) -> DataFrame:
        prefix, ends = ("_l", SEG) if left else ("_r", WALL)
        kept = [F.struct(*[F.col(c) for c in names]) if (names is keep_l) == left else F.lit(None).cast(of) for names, of in ((keep_l, kinds[0]), (keep_r, kinds[1]))]
        box = [F.col(prefix + c).alias(c) for c in ("x0", "y0", "x1", "y1")]
        at = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(n) for c, n in zip(ends, ("sx", "sy", "ex", "ey"))]
        return cells.select(*cell, "_part", F.lit(int(left)).alias("_left"), F.col(prefix + "own").alias("_own"), *box, *at, kept[0].alias("_l"), kept[1].alias("_r"))

    kinds = [cells.select(F.struct(*names).alias("s")).schema["s"].dataType.simpleString() for cells, names in ((lcells, keep_l), (rcells, keep_r))]
    if many.isEmpty():
        lcells, rcells = (cells.withColumn("_part", F.lit(0)) for cells in (lcells, rcells))
    else:
        whose = F.xxhash64(*[F.col(c) for c in (*keep_l, *SEG)])
        part = F.coalesce(F.pmod(whose, F.col("_parts")).cast("int"), F.lit(0))
        lcells = lcells.join(F.broadcast(many), list(cell), "left").withColumn("_part", part)
        parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
        rcells = rcells.join(F.broadcast(many), list(cell), "left").withColumn("_part", F.explode(parts))
    place = [*cell, "_part"]
    both = rows(lcells, True).unionByName(rows(rcells, False)).repartition(partitions(lcells), *place).sortWithinPartitions(*place, "_left")
    schema = StructType([*lcells.select(*keep_l).schema.fields, *rcells.select(*keep_r).schema.fields])
    return both.mapInArrow(_matcher(place, [*keep_l, *keep_r], tol, base), schema).select(*columns)


def _matcher(place: list[str], names: list[str], tol: g.Tolerance, base: float):
    """The function of ``mapInArrow`` that turns the sorted rows of cells into pairs; walls come before the segments of their cell."""

    def arrays(rows: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
        return {c: rows[c].to_numpy() for c in ("_own", "x0", "y0", "x1", "y1", "sx", "sy", "ex", "ey")}

    def met(a: dict[str, np.ndarray], z: dict[str, np.ndarray], level: int, cx: int, cy: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size, m = base * 2.0**level, len(z["x0"])
        for start in range(0, len(a["x0"]), max(1, BLOCK // m)):
            rows = slice(start, start + max(1, BLOCK // m))
            near = (a["x0"][rows, None] <= z["x1"]) & (z["x0"] <= a["x1"][rows, None])
            near &= (a["y0"][rows, None] <= z["y1"]) & (z["y0"] <= a["y1"][rows, None])
            i, j = np.divmod(np.flatnonzero(near), m)
            i += start
            # A pair meets on the coarser of its levels, in one agreed cell.
            here = np.maximum(a["_own"][i], z["_own"][j]) == level
            here &= np.floor(np.maximum(a["x0"][i], z["x0"][j]) / size) == cx
            here &= np.floor(np.maximum(a["y0"][i], z["y0"][j]) / size) == cy
            i, j = i[here], j[here]
            touch = g.touching(*[a[c][i] for c in ("sx", "sy", "ex", "ey")], *[z[c][j] for c in ("sx", "sy", "ex", "ey")], tol)
            yield i[touch], j[touch]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walls, held, sides = None, [], None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch[c].to_numpy() for c in (*place, "_left")]).astype("int64")
            turns = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for start, end in pairwise([0, *turns.tolist(), batch.num_rows]):
                here, part = tuple(at[:-1, start].tolist()), batch.slice(start, end - start)
                if here != key:
                    key, walls, held = here, [], None
                if not at[-1, start]:
                    walls.append(part)
                elif walls:
                    if held is None:
                        whole = pa.Table.from_batches(walls).combine_chunks()
                        held, sides = whole["_r"].chunk(0), arrays(whole)
                    for i, j in met(arrays(part), sides, *here[:3]):
                        for first in range(0, len(i), HANDED):
                            some = slice(first, first + HANDED)
                            columns = part["_l"].take(pa.array(i[some])).flatten() + held.take(pa.array(j[some])).flatten()
                            yield pa.RecordBatch.from_arrays(columns, names)

    return match


def within_distance(
    segments: DataFrame, sides: DataFrame, limit: float, base: float = 1.0, on: Sequence[str] = (), dealt: bool = False
) -> DataFrame:
    """Segments (ax..by_) closer than ``limit`` to sides (cx..dy), with their distance."""
    near = bbox_join(segments, sides, _span(*SEG), _span(*WALL), base, on, pad=limit, dealt=dealt)
    cols = [F.col(c).cast("double") for c in SEG + WALL]
    return near.withColumn("gap", g.segment_gaps(*cols)).filter(F.col("gap") < limit)


def boundary(polygons: DataFrame, *keys: str) -> DataFrame:
    """Sides (cx, cy, dx, dy) of every ring, numbered by ``side_ord``."""
    spread = polygons.select(*keys, F.posexplode(g.ring_sides(F.col("ring"))).alias("side_ord", "s"))
    return spread.select(
        *keys,
        "side_ord",
        F.col("s.a.x").alias("cx"),
        F.col("s.a.y").alias("cy"),
        F.col("s.b.x").alias("dx"),
        F.col("s.b.y").alias("dy"),
    )


def _stretches(
    segments: DataFrame, outlines: DataFrame, key: str, name: Sequence[str], tol: g.Tolerance, base: float, on: Sequence[str]
) -> DataFrame:
    """Stretches t0..t1 of each segment between its contacts with each framed outline whose box it meets, and their middle
    point; containment cannot change inside a stretch.  A pair of segment and outline is one window of its contacts."""
    ends = segments.select(key, *on, *SEG)
    near = bbox_join(ends, outlines.select(*name, *BOX, *FRAME), _span(*SEG), [F.col(c) for c in BOX], base, on, pad=tol.eps)
    pairs = near.select(key, *name, *SEG, *FRAME, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    met = bbox_join(ends, boundary(outlines.select(*name, *FRAME, "ring"), *name, *FRAME), _span(*SEG), _span(*WALL), base, on, pad=tol.eps)
    cuts = contacts(met, tol).select(key, *name, *SEG, *FRAME, "t")
    # A side within reach of the segment has its outline's box within reach too, so every cut has its pair.
    along = Window.partitionBy(key, *name).orderBy("t")
    parts = pairs.union(cuts).withColumn("t1", F.lead("t").over(along)).filter("t1 > t").withColumnRenamed("t", "t0")
    middle = (F.col("t0") + F.col("t1")) / 2
    return parts.withColumns(
        {"mid_x": F.col("ax") + (F.col("bx") - F.col("ax")) * middle, "mid_y": F.col("ay") + (F.col("by_") - F.col("ay")) * middle}
    )


#: Cells along the longer side of a rectangle, and the most cells a segment may take to be settled by them.
RECT_CELLS, SEGMENT_CELLS = 16, 64
#: Beyond this many units cells would be no finer than the numbers.
CELL_REACH = 2.0**40


def _held_by_cells(segments: DataFrame, outlines: DataFrame, key: str, base: float) -> DataFrame:
    """Keys of segments all of whose cells lie inside rectangles among the outlines, so inside their union.

    Cells inside any rectangle are kept once, so where outlines lie thick no segment meets them one by one.
    """
    p = [F.get("ring", F.lit(i)) for i in range(4)]
    across = (p[0]["y"] == p[1]["y"]) & (p[1]["x"] == p[2]["x"]) & (p[2]["y"] == p[3]["y"]) & (p[3]["x"] == p[0]["x"])
    upright = (p[0]["x"] == p[1]["x"]) & (p[1]["y"] == p[2]["y"]) & (p[2]["x"] == p[3]["x"]) & (p[3]["y"] == p[0]["y"])
    box = [F.col(c) for c in BOX]
    near = lambda limits: F.greatest(*[F.abs(c) for c in limits]) < F.lit(base * CELL_REACH)
    longer = F.greatest(box[2] - box[0], box[3] - box[1], F.lit(base)) / F.lit(base * RECT_CELLS)
    level = F.greatest(F.lit(0), F.ceil(F.log2(longer)).cast("int"))
    boxes = outlines.filter((F.size("ring") == 4) & (across | upright) & near(box)).select(*BOX, level.alias("_level"))
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda c: F.floor(c / size).cast("long")
    whole = boxes.withColumns({"_x0": F.ceil(box[0] / size).cast("long"), "_x1": cell(box[2]) - 1, "_y0": F.ceil(box[1] / size).cast("long"), "_y1": cell(box[3]) - 1})
    whole = whole.filter("_x0 <= _x1 and _y0 <= _y1").select("_level", "_y0", "_y1", F.explode(F.sequence("_x0", "_x1")).alias("_cx"))
    # Neighbouring rectangles share most cells: equal ones go before rows are shuffled.
    whole = whole.select("_level", "_cx", F.explode(F.sequence("_y0", "_y1")).alias("_cy")).distinct()
    levels = boxes.agg(F.collect_set("_level")).scalar()
    span = [c.cast("double") for c in _span(*SEG)]
    asked = segments.select(key, *[c.alias(n) for n, c in zip(BOX, span)])
    asked = asked.filter(real_box(box) & near(box)).withColumn("_level", F.explode(levels))
    asked = asked.withColumns({"_x0": cell(box[0]), "_x1": cell(box[2]), "_y0": cell(box[1]), "_y1": cell(box[3])})
    asked = asked.withColumn("_n", (F.col("_x1") - F.col("_x0") + 1) * (F.col("_y1") - F.col("_y0") + 1)).filter(F.col("_n") <= SEGMENT_CELLS)
    asked = asked.select(key, "_level", "_n", "_y0", "_y1", F.explode(F.sequence("_x0", "_x1")).alias("_cx"))
    asked = asked.select(key, "_level", "_n", "_cx", F.explode(F.sequence("_y0", "_y1")).alias("_cy"))
    met = asked.join(whole, ["_level", "_cx", "_cy"], "left_semi").groupBy(key, "_level", "_n").agg(F.count(F.lit(1)).alias("_met"))
    return met.filter(F.col("_met") == F.col("_n")).select(key).distinct()


def uncovered_by_union(
    segments: DataFrame,
    polygons: DataFrame,
    key: str,
    poly_key: Sequence[str],
    tol: g.Tolerance = g.ROUTER,
    base: float = 1.0,
    on: Sequence[str] = (),
) -> DataFrame:
    """Keys (and groups ``on``) of segments with an end point or a stretch outside the union of the polygons.

    The stretches inside single outlines are merged along each segment and must leave no gap from end to end.  Outlines
    without groups first settle the segments that lie in cells inside rectangles.
    """
    name = [*on, *poly_key]
    outlines = framed(polygons, name)
    if not on:
        segments = cut(segments.join(_held_by_cells(segments, outlines, key, base), key, "left_anti"))
    parts = _stretches(segments, outlines, key, name, tol, base, on)
    length = g.norm(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    parts = parts.withColumn("slack", F.lit(2 * tol.eps) / F.greatest(length, F.lit(tol.eps)))
    held = inside(parts, side_slabs(outlines, name, tol.eps), name, [key, *name, "t0", "t1", "slack", "mid_x", "mid_y"], "mid_x", "mid_y", tol)
    # How far the stretches before reach; very many outlines on one segment are scanned in chunks.
    order = ["t0", "t1", *name]
    own = [*on, key]
    swept = running_max(held, own, order, F.floor(F.col("t0") * 64), F.col("t1"), "reach")
    found = swept.groupBy(*own).agg(
        F.max(F.col("t0") > F.coalesce("reach", F.lit(0.0)) + F.col("slack")).alias("gap"), F.max(F.col("t1") >= 1 - F.col("slack")).alias("done")
    )
    covered = found.filter(~F.col("gap") & F.col("done")).select(*own)
    return segments.select(*own).distinct().join(looked_up(covered), own, "left_anti")


class Domains(NamedTuple):
    """Sides, frames and slabs of domains, derived once for several searches; ``whole``: few enough for every executor."""

    sides: DataFrame
    frames: DataFrame
    slabs: DataFrame
    whole: bool


def indexed(domains: DataFrame, eps: float) -> Domains:
    """The index of the domains, for tolerances up to ``eps``.

    Sides are counted: Spark judges them by the files they come from, and would deal all points by the few domains there are.
    """
    outlines = cut(framed(domains, ["domain_id"], several=True))
    sides = cut(boundary(outlines.select("domain_id", "ring"), "domain_id"))
    frames, slabs = cut(outlines.select("domain_id", *FRAME).distinct()), cut(side_slabs(outlines, ["domain_id"], eps))
    whole = sides.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return Domains(sides, F.broadcast(frames), F.broadcast(slabs), True) if whole else Domains(sides, frames, slabs, False)


def within_domain(segments: DataFrame, domains: DataFrame | Domains, key: str, tol: g.Tolerance = g.ROUTER, base: float = 1.0) -> DataFrame:
    """Keys of the segments (key, domain_id, ax..by_) that lie in their domain, its border included.

    A domain is all rings under one ``domain_id``, parts and holes.  A segment is cut where it meets sides; every stretch
    between has to be inside.
    """
    if isinstance(domains, DataFrame):
        outlines = framed(domains, ["domain_id"], several=True)
        sides = boundary(outlines.select("domain_id", "ring"), "domain_id")
        domains = Domains(sides, outlines.select("domain_id", *FRAME).distinct(), side_slabs(outlines, ["domain_id"], tol.eps), False)
    own = segments.select(key, "domain_id", *SEG)
    met = bbox_join(own, domains.sides, _span(*SEG), _span(*WALL), base, ["domain_id"], pad=tol.eps, whole=domains.whole)
    ends = own.select("*", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    parts = ends.union(contacts(met, tol).select(*own.columns, "t")).withColumn("t1", F.lead("t").over(Window.partitionBy(key).orderBy("t")))
    middle = (F.col("t") + F.col("t1")) / 2
    at = {"mid_x": F.col("ax") + (F.col("bx") - F.col("ax")) * middle, "mid_y": F.col("ay") + (F.col("by_") - F.col("ay")) * middle}
    parts = parts.filter("t1 > t").withColumns(at).select(key, "domain_id", "t", "mid_x", "mid_y")
    held = inside(parts.join(domains.frames, "domain_id"), domains.slabs, ["domain_id"], [key, "t"], "mid_x", "mid_y", tol)
    marks = parts.select(key, F.lit(1).alias("n")).union(held.select(key, F.lit(-1).alias("n")))
    return marks.groupBy(key).agg(F.sum("n").alias("n")).filter("n = 0").select(key)


def few_sides(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides of domains with at most ``FEW_BOXES`` of them, which are met as a whole, and the ``domain_id`` of the others.

    Sides without real ends are left out."""
    sides = cut(sides.select("domain_id", *[F.col(c).cast("double").alias(c) for c in WALL]).filter(real_box([F.col(c) for c in WALL])))
    many = cut(sides.groupBy("domain_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW_BOXES).select("domain_id"))
    return sized(sides.join(many, "domain_id", "left_anti")), many


def nearest_sides(points: DataFrame, sides: DataFrame, key: str, reach: float) -> DataFrame:
    """Distance ``gap`` from each point (key, domain_id, x, y) to the nearest side (domain_id, cx..dy) of its domain.

    Only sides within a reach are met; what lies within the reach is final, the other points look four times as far.
    """
    found: DataFrame | None = None
    waiting = cut(points.select(key, "domain_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")))
    waiting = waiting.join(sides.select("domain_id").distinct(), "domain_id", "left_semi")
    while True:
        spot = [F.col("px"), F.col("py"), F.col("px"), F.col("py")]
        near = bbox_join(waiting, sides.select("domain_id", *WALL), spot, _span(*WALL), reach, ["domain_id"], pad=reach)
        gap = g.point_segment_distance(F.col("px"), F.col("py"), *[F.col(c) for c in WALL])
        best = cut(near.groupBy(key).agg(F.min(gap).alias("gap")).filter(F.col("gap") <= reach))
        found = best if found is None else found.unionByName(best)
        waiting = cut(waiting.join(best, key, "left_anti"))
        if waiting.isEmpty():
            return found
        reach *= 4


def interior_overlap(
    segments: DataFrame, polygons: DataFrame, key: str, poly_key: str, tol: float, base: float = 1.0
) -> DataFrame:
    """Length of every segment inside every polygon's interior, where it exceeds ``tol``."""
    outlines = framed(polygons, [poly_key])
    parts = _stretches(segments, outlines, key, [poly_key], g.ROUTER, base, ())
    length = (F.col("t1") - F.col("t0")) * g.norm(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    parts = parts.withColumn("inside", length)
    held = inside(parts, side_slabs(outlines, [poly_key], g.OUTLINE.eps), [poly_key], [key, poly_key, "t0", "inside"], "mid_x", "mid_y", border=False)
    return held.groupBy(key, poly_key).agg(F.sum("inside").alias("inside")).filter(F.col("inside") > tol)


def overlap_pairs(polygons: DataFrame, key: str, tol: float = 1.0, base: float = 1.0) -> DataFrame:
    """Polygon pairs (left_id < right_id) sharing at least ``tol`` of area; rings are simple, and may be concave.

    The shared region is bounded by the stretches of each outline inside the other, so its area is half the sum of their
    cross terms, all outlines turned the same way.  Where two outlines run together in one direction the stretch bounds the
    region from both sides and counts half for each; against each other they bound nothing.
    """
    ring = F.when(g.ring_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring"))
    outlines = framed(polygons.select(F.col(key).alias("other"), ring.alias("ring"), *BOX), ["other"])
    sides = boundary(outlines.select(F.col("other").alias("own"), "ring"), "own")
    sides = sides.select(F.struct("own", "side_ord").alias("side"), *[F.col(c).alias(s) for c, s in zip(WALL, SEG)])
    parts = _stretches(sides, outlines, "side", ["other"], g.ROUTER, base, ()).filter(F.col("side.own") != F.col("other"))
    ux, uy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    at = lambda t: (F.col("ax") + ux * F.col(t), F.col("ay") + uy * F.col(t))
    parts = parts.withColumns({"turn": g.cross(*at("t0"), *at("t1")), "ux": ux, "uy": uy})
    keep = ["side", "other", "t0", "turn", "mid_x", "mid_y", "ux", "uy"]
    along = (F.col("dx") - F.col("cx")) * F.col("ux") + (F.col("dy") - F.col("cy")) * F.col("uy")
    found = judged(parts.select(*keep, *FRAME), side_slabs(outlines, ["other"], g.ROUTER.eps), ["other"], keep, "mid_x", "mid_y", g.ROUTER, along=along)
    share = F.when(F.col("on"), F.when(F.col("along") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).otherwise(F.col("odd").cast("double"))
    own = F.col("side.own")
    areas = found.groupBy(F.least(own, F.col("other")).alias("left_id"), F.greatest(own, F.col("other")).alias("right_id")).agg(
        (F.sum(F.col("turn") * share) / 2).alias("area")
    )
    return areas.filter(F.col("area") >= tol)


def bbox_overlap(crops: DataFrame, paths: DataFrame, base: float = 1.0) -> DataFrame:
    """Path ids per crop whose boxes share area (open comparison), sorted; crops: crop_id, c_x0..c_y1."""
    crop = [F.col(f"c_{c}") for c in ("x0", "y0", "x1", "y1")]
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    near = bbox_join(crops, paths, crop, box, base)
    open_ = (box[0] < crop[2]) & (box[2] > crop[0]) & (box[1] < crop[3]) & (box[3] > crop[1])
    return near.filter(open_)


def nearest_pairs(a: DataFrame, z: DataFrame, dx: float, dy: float, reach: float = 16.0) -> DataFrame:
    """Per ``anchor`` text the pair (a_id, z_id) closest to the expected shift, and its residual.

    Only pairs within a growing reach are formed: a pair found inside the reach settles its anchor,
    the others widen, so a frequent text never forms all its pairs.  Equal positions are merged first;
    rows without a real position take no part, so an anchor with none of them on one side has no pair.
    """
    a = a.filter(g.is_finite(F.col("ax")) & g.is_finite(F.col("ay")))
    z = z.filter(g.is_finite(F.col("zx")) & g.is_finite(F.col("zy")))
    left = a.groupBy("anchor", "ax", "ay").agg(F.min("a_id").alias("a_id"))
    right = z.select("anchor", "z_id", (F.col("zx") + dx).alias("zx"), (F.col("zy") + dy).alias("zy"))
    right = right.groupBy("anchor", "zx", "zy").agg(F.min("z_id").alias("z_id"))
    shared = left.select("anchor").distinct().join(right.select("anchor").distinct(), "anchor")
    left, right = cut(left.join(shared, "anchor", "left_semi")), cut(right.join(shared, "anchor", "left_semi"))
    found: DataFrame | None = None
    while True:
        cell = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
        near3 = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
        lc = left.withColumns({"_cx": cell("ax"), "_cy": cell("ay")})
        rc = right.withColumn("_cx", near3("zx")).withColumn("_cy", near3("zy"))
        gap = g.norm(F.col("ax") - F.col("zx"), F.col("ay") - F.col("zy"))
        best = (
            lc.join(rc, ["anchor", "_cx", "_cy"])
            .withColumn("residual", gap)
            .filter(F.col("residual") <= reach)
            .groupBy("anchor")
            .agg(F.min(F.struct("residual", "a_id", "z_id")).alias("_b"))
        )
        best = cut(best.select("anchor", "_b.*"))
        found = best if found is None else found.unionByName(best)
        left, right = (cut(d.join(best, "anchor", "left_anti")) for d in (left, right))
        if left.isEmpty():
            return found.select("anchor", "a_id", "z_id", "residual")
        reach *= 4


#: Squares of cells around a point that are searched one after the other before the whole window.
SNAP_REACHES = (3,)
#: Wide enough for every point from which a connector can count as inside.
NEAR_DOMAIN = g.Tolerance(1e-4, floor=1.0)


def snap_to_grid(
    points: DataFrame, cells: DataFrame, step: float, window: int = 10, domains: DataFrame | Domains | None = None, base: float = 1.0,
    carry: Sequence[str] = (), held: bool = False,
) -> DataFrame:
    """Nearest grid vertex within +-window cells of each point that it sees; coincident vertices are not connectors.

    points: point_id, x, y (and domain_id); cells: ix, iy (vertex at step*ix, step*iy).  With ``domains`` the straight
    connector has to lie in the point's domain: the nearest vertex is tried first, then growing squares around the point.
    What lies nearer than any vertex outside the square is final, and only the other points go on; points outside their
    domain see nothing.  Ties go to the lower row, then column.  With ``domains`` the columns ``carry`` of the points come
    back with them, so that nothing has to be joined to them again; ``held``: the points are known to lie in their domain.
    """
    cells = cells.select("ix", "iy").distinct()

    def around(rows: DataFrame, reach: int, done: int = -1) -> DataFrame:
        """Vertices in the square of ``reach`` cells around each point, but for those of the square ``done``."""
        near_x, near_y = F.rint(F.col("x") / step).cast("long"), F.rint(F.col("y") / step).cast("long")
        spots = F.array(
            *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if max(abs(i), abs(j)) > done]
        )
        asked = rows.withColumn("_o", F.explode(spots)).withColumns({"ix": near_x + F.col("_o.i"), "iy": near_y + F.col("_o.j")}).drop("_o")
        gap = g.norm(F.col("ix") * step - F.col("x"), F.col("iy") * step - F.col("y"))
        return asked.join(cells, ["ix", "iy"]).withColumn("gap", gap).filter(F.col("gap") > 0.001)

    def best(rows: DataFrame, of: Sequence[str] = ("point_id",)) -> DataFrame:
        least = rows.groupBy(*of).agg(F.min(F.struct("gap", "iy", "ix")).alias("_b"))
        return least.select(*of, F.col("_b.ix").alias("ix"), F.col("_b.iy").alias("iy"), F.col("_b.gap").alias("gap"))

    if domains is None:
        return best(around(points, window))
    cells = sized(cells)
    if isinstance(domains, DataFrame):
        domains = indexed(domains, NEAR_DOMAIN.eps)
    own = list(dict.fromkeys(["point_id", "domain_id", "x", "y", *carry]))
    waiting = points.select(*own)
    if not held:
        waiting = inside(waiting.join(domains.frames, "domain_id"), domains.slabs, ["domain_id"], own, "x", "y", NEAR_DOMAIN)
    # Few bytes of points become many connectors: they stay dealt to all slices.
    waiting = cut(waiting.repartition(partitions(points), "point_id"))

    def visible(near: DataFrame) -> DataFrame:
        at = {"ax": F.col("x"), "ay": F.col("y"), "bx": F.col("ix") * step, "by_": F.col("iy") * step}
        name = F.concat_ws("/", F.col("point_id").cast("string"), "ix", "iy")
        tries = cut(near.withColumns({c: v.cast("double") for c, v in at.items()}).withColumn("_connector", name))
        return tries.join(within_domain(tries, domains, "_connector", g.ROUTER, base), "_connector", "left_semi")

    # No vertex outside a square is as near as half a cell beyond it.
    beyond = lambda reach: F.col("gap") >= (reach + 0.5) * step * (1 - 1e-9)
    nearest = best(around(waiting, min(1, window)), own).filter(~beyond(min(1, window)))
    found = cut(best(visible(nearest), own))
    waiting = cut(waiting.join(found, "point_id", "left_anti"))
    tentative, done = found.limit(0), -1
    for reach in [r for r in SNAP_REACHES if r < window] + [window]:
        if waiting.isEmpty():
            break
        seen = cut(best(visible(around(waiting, reach, done)).select(*tentative.columns).unionByName(tentative), own))
        final = ~beyond(reach) if reach < window else F.lit(True)
        settled, tentative, done = seen.filter(final), seen.filter(~final), reach
        found = found.unionByName(settled)
        waiting = cut(waiting.join(settled, "point_id", "left_anti"))
    return found.select("point_id", *carry, "ix", "iy", "gap")


def accept_faces(
    labels: DataFrame, faces: DataFrame, max_area: float, denied: Column, base: float = 1.0
) -> DataFrame:
    """Typed outcome per label: accepted outline, or why not.

    labels: label_id, number, x, y; faces: face_id, area, ring and box.  A face is accepted when it is
    the only one around the label, not larger than ``max_area``, holds no other number, and is not denied.
    """
    within = points_in_polygons(labels, faces.select("face_id", "area", "ring", *BOX), ["face_id"], base=base)
    others = within.groupBy("face_id").agg(F.count_distinct("number").alias("_numbers"))
    per = within.join(others, "face_id").groupBy("label_id").agg(
        F.count(F.lit(1)).alias("faces"),
        F.min("face_id").alias("face_id"),
        F.max("area").alias("_area"),
        F.max("_numbers").alias("_numbers"),
    )
    joined = labels.join(per, "label_id", "left")
    one = F.coalesce(F.col("faces"), F.lit(0)) == 1
    reason = (
        F.when(~one, "no single face")
        .when(F.col("_area") > max_area, "unbounded face")
        .when(F.col("_numbers") > 1, "shared face")
        .when(denied, "denied")
        .otherwise("accepted")
    )
    return joined.select("label_id", "number", reason.alias("outcome"), F.when(reason == "accepted", F.col("face_id")).alias("face_id"))
