"""Turn instructions of many routes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions.geometry import norm, path_sides
from concourse.functions.text import without_full_stop
from concourse.operators.ordered import neighbours, ordinal_chunk
from concourse.operators.sequences import fold_continue, heading_change, turn_of
from concourse.session import held

# Instruction texts.
TEXTS = {
    "start": ("Start here and follow the route.", "ابدأ من هنا واتبع المسار."),
    "continue": ("Continue straight.", "تابع السير مباشرة."),
    "slight-left": ("Bear slightly left.", "اتجه قليلاً إلى اليسار."),
    "slight-right": ("Bear slightly right.", "اتجه قليلاً إلى اليمين."),
    "left": ("Turn left.", "انعطف يساراً."),
    "right": ("Turn right.", "انعطف يميناً."),
    "enter-corridor": ("Enter the corridor.", "ادخل الممر."),
    "stairs": ("Take the stairs.", "استخدم الدرج."),
    "elevator": ("Take the elevator.", "استخدم المصعد."),
    "destination-left": ("Your destination is on the left.", "وجهتك على اليسار."),
    "destination-right": ("Your destination is on the right.", "وجهتك على اليمين."),
    "arrival": ("You have arrived at your destination.", "لقد وصلت إلى وجهتك."),
}
TO_FLOOR = (" to floor ", " إلى الطابق ")
SHORT = 1e-7
ENTRY_TYPES = ("door", "entrance")
VERTICAL = ("stairs", "elevator")
ROW = "struct<sub:int,type:string,node:string,distance:double,floor:string>"


def render_text(instructions: DataFrame) -> DataFrame:
    """Add text_en and text_ar; a lift or stair that changes floor (``floor`` set) names the floor."""
    def text(i: int) -> Column:
        out = F.lit(None).cast("string")
        for kind, words in TEXTS.items():
            out = F.when(F.col("type") == kind, words[i]).otherwise(out)
        named = F.concat(without_full_stop(out), F.lit(TO_FLOOR[i]), F.col("floor"), F.lit("."))
        return F.when(F.col("floor").isNotNull(), named).otherwise(out)

    return instructions.withColumns({"text_en": text(0), "text_ar": text(1)})


def _vectors(path: Column) -> Column:
    moves = F.transform(
        path_sides(path),
        lambda s: F.struct((s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy")),
    )
    return F.filter(moves, lambda v: norm(v["dx"], v["dy"]) > SHORT)


def _turn(u: Column, v: Column) -> Column:
    return turn_of(heading_change(u["dx"], u["dy"], v["dx"], v["dy"]))


def instructions(steps: DataFrame, routes: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Ordered instructions: route_id, ord, type, node, distance, floor, text_en, text_ar, and the columns ``scope`` of both sides.

    steps: route_id, ord (1-based), from_node, to_node, from_floor, to_floor, from_type, to_type,
    to_room, path_type, cost, path (points in walking order); routes: route_id, start_node.
    A row's position is (step, sub); start and arrival close the two ends.
    """
    route = [*scope, "route_id"]
    chunk = ordinal_chunk("ord")
    vertical = F.col("path_type").isin(*VERTICAL)
    s = steps.withColumn("vec", _vectors(F.col("path")))
    heading = F.struct(F.lit(False).alias("reset"), F.element_at("vec", -1).alias("v"))
    # After a stair or lift there is no heading; steps without length keep the former one.
    none = F.struct(F.lit(True).alias("reset"), F.lit(None).cast("struct<dx:double,dy:double>").alias("v"))
    mark = F.when(vertical, none).when(F.size("vec") > 0, heading)
    beside = {"prev": {"_prev_path": "path_type"}, "next": {"_next": "ord"}, "known": {"_in": mark}}
    s = neighbours(s, route, ["ord"], chunk, **beside)
    incoming = F.col("_in.v")
    first_step = F.col("_prev_path").isNull()
    last_step = F.col("_next").isNull()
    has_turn = incoming.isNotNull() & (F.size("vec") > 0)
    direction = F.when(has_turn, _turn(incoming, F.get("vec", F.lit(0)))).otherwise("continue")
    final_door = last_step & (F.col("path_type") == "door") & (
        (F.col("to_type") == "door") | F.col("to_room").isNotNull()
    )

    def row(sub: int | Column, kind: Column | str, node: str, distance: Column | None, floor: Column | None = None) -> Column:
        return F.struct(
            (sub if isinstance(sub, Column) else F.lit(sub)).cast("int").alias("sub"),
            (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"),
            F.col(node).alias("node"),
            (distance if distance is not None else F.lit(None)).cast("double").alias("distance"),
            (floor if floor is not None else F.lit(None)).cast("string").alias("floor"),
        )

    empty = F.array().cast(f"array<{ROW}>")

    def maybe(cond: Column, r: Column) -> Column:
        return F.when(cond, F.array(r)).otherwise(empty)

    cost = F.col("cost")
    moved = F.when(F.col("from_floor") != F.col("to_floor"), F.col("to_floor"))
    lift = F.array(row(0, F.col("path_type"), "from_node", cost, moved))
    side = F.when(direction.contains("left"), "destination-left").otherwise("destination-right")
    beside = final_door & (direction != "continue")
    entering = (F.col("path_type") == "corridor") & (
        F.col("from_type").isin(*ENTRY_TYPES) | F.coalesce(F.col("_prev_path").isin(*ENTRY_TYPES), F.lit(False))
    )
    bends = F.transform(
        F.arrays_zip(
            F.slice("vec", F.lit(1), F.greatest(F.size("vec") - 1, F.lit(0))).alias("u"),
            F.slice("vec", F.lit(2), F.greatest(F.size("vec") - 1, F.lit(0))).alias("v"),
        ),
        lambda p, i: row(i + 2, _turn(p["u"], p["v"]), "from_node", None),
    )
    walk = F.concat(
        maybe(beside, row(0, side, "to_node", cost)),
        maybe(~beside & ~first_step, row(0, direction, "from_node", cost)),
        maybe(~beside & entering, row(1, "enter-corridor", "from_node", None)),
        F.filter(bends, lambda r: r["type"] != "continue"),
    )
    rows = s.select(*route, "ord", F.explode(F.when(vertical, lift).otherwise(walk)).alias("r")).select(*route, "ord", "r.*")
    ends = steps.groupBy(*route).agg(
        F.min_by("cost", "ord").alias("first_cost"), F.max_by("to_node", "ord").alias("end_node"), F.max("ord").alias("steps")
    )
    ends = routes.select(*route, "start_node").join(held(ends), route, "left")
    nothing = F.lit(None).cast("string").alias("floor")
    opening = ends.select(
        *route,
        F.lit(0).cast("long").alias("ord"),
        F.lit(0).alias("sub"),
        F.lit("start").alias("type"),
        F.col("start_node").alias("node"),
        F.coalesce(F.col("first_cost").cast("double"), F.lit(0.0)).alias("distance"),
        nothing,
    )
    closing = ends.select(
        *route,
        (F.coalesce("steps", F.lit(0)) + 1).cast("long").alias("ord"),
        F.lit(0).alias("sub"),
        F.lit("arrival").alias("type"),
        F.coalesce("end_node", "start_node").alias("node"),
        F.lit(0.0).alias("distance"),
        nothing,
    )
    everything = opening.unionByName(rows.withColumn("ord", F.col("ord").cast("long"))).unionByName(closing)
    folded = fold_continue(everything, "route_id", ["ord", "sub"], ordinal_chunk("ord"), scope)
    return render_text(folded)
