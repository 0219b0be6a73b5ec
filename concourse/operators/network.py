"""Graph operators on edge tables: eligibility, direction, costs, paths, reachability, contraction.

Searches relax only improved rows.  Every round is one declarative join and aggregate whose result is
checkpointed; the driver sees nothing but whether any row improved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concourse.session import cut, held, whole_groups

VERIFIED, DRAWING = "verified-only", "drawing-based"
#: Rounds of a search whose settled labels are read where they were met, before they are brought together.
SETTLED_ROUNDS = 3


def evidence_ok(status: str, policy: Column) -> Column:
    """Confirmed evidence always counts; candidate evidence only under the drawing-based policy."""
    drawing = F.coalesce(policy, F.lit(VERIFIED)) == DRAWING
    return (F.col(status) == "confirmed") | (drawing & (F.col(status) == "candidate"))


def supported(df: DataFrame, policy: str | Column = VERIFIED, status: str = "status") -> DataFrame:
    return df.filter(evidence_ok(status, F.lit(policy) if isinstance(policy, str) else policy))


def passable(policy: Column, restriction: str = "restriction") -> Column:
    drawing = F.coalesce(policy, F.lit(VERIFIED)) == DRAWING
    return (F.col(restriction) == "open") | (drawing & (F.col(restriction) == "unknown"))


def open_edges(df: DataFrame, policy: str = VERIFIED) -> DataFrame:
    return df.filter(passable(F.lit(policy)))


def step_free() -> Column:
    return (F.col("accessibility") == "confirmed") & (F.col("path_type") != "stairs")


def accessible_edges(df: DataFrame) -> DataFrame:
    return df.filter(step_free())


def directed(
    edges: DataFrame,
    policy: str = VERIFIED,
    accessible: bool = False,
    meters_per_unit: Column | None = None,
) -> DataFrame:
    """Eligible steps ``src -> dst``; two-way edges appear twice, the back step with reversed geometry.

    With a confirmed scale, drawing-unit costs turn into metres.
    """
    usable = open_edges(supported(edges, policy), policy)
    if accessible:
        usable = accessible_edges(usable)
    cost = F.col("cost")
    if meters_per_unit is not None and "distance_unit" in edges.columns:
        cost = F.when(F.col("distance_unit") == "map-unit", cost * meters_per_unit).otherwise(cost)
    keep = [c for c in edges.columns if c not in ("from_node", "to_node", "cost", "geometry")]
    shape = "geometry" in edges.columns

    def step(src: str, dst: str, geometry: Column | None) -> Column:
        fields = [F.col(src).alias("src"), F.col(dst).alias("dst")]
        return F.struct(*fields, *([geometry.alias("geometry")] if shape else []))

    forward = step("from_node", "to_node", F.col("geometry") if shape else None)
    back = step("to_node", "from_node", F.reverse("geometry") if shape else None)
    steps = F.when(F.col("bidirectional"), F.array(forward, back)).otherwise(F.array(forward))
    spread = usable.select(*keep, cost.alias("cost"), F.explode(steps).alias("_step"))
    return spread.select(*keep, "cost", "_step.*")


def _sound(steps: DataFrame) -> DataFrame:
    """Steps whose missing, negative and NaN costs fail when they are read."""
    sound = (F.col("cost") >= 0) & ~F.isnan(F.col("cost").cast("double"))
    bad = F.raise_error(F.concat(F.lit("unusable cost on edge "), F.col("edge_id").cast("string")))
    return steps.withColumn("cost", F.when(sound, F.col("cost")).otherwise(bad.cast(steps.schema["cost"].dataType)))


def shortest_tree(steps: DataFrame, sources: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Best ``(cost, hops, pred, edge_id)`` per source and reachable node.

    ``steps`` needs src, dst, cost and edge_id, ``sources`` a ``source`` column; ``scope`` names shared
    columns (a graph id, a mode) that both carry.  Ties go to fewer hops, then lower predecessor and
    edge ids, so equal-cost cycles cannot loop.  A missing, negative or NaN cost fails the search before
    it starts: a negative cycle would have no end.
    """
    scope = list(scope)
    group = scope + ["source"]
    # Of parallel steps only the cheapest can be chosen, and of equal ones the lower edge.
    ends = scope + ["src", "dst"]
    steps = _sound(steps).select(*ends, F.struct("cost", "edge_id").alias("_s")).groupBy(*ends).agg(F.min("_s").alias("_s"))
    steps = cut(steps.select(*ends, "_s.*"))
    node_type, edge_type = steps.schema["src"].dataType, steps.schema["edge_id"].dataType
    zero = F.lit(0).cast(steps.schema["cost"].dataType)

    def label(cost: Column, hops: Column, pred: Column, edge: Column) -> Column:
        return F.struct(cost.alias("cost"), hops.alias("hops"), pred.alias("pred"), edge.alias("edge_id"))

    start = label(zero, F.lit(0), F.lit(None).cast(node_type), F.lit(None).cast(edge_type))
    best = cut(
        sources.select(*group)
        .distinct()
        .select(*group, F.col("source").cast(node_type).alias("node"), start.alias("best"), F.lit(True).alias("fresh"))
    )
    settled: list[DataFrame] = []
    while True:
        frontier = best.filter("fresh").select(
            *group, F.col("node").alias("src"), F.col("best.cost").alias("_cost"), F.col("best.hops").alias("_hops")
        )
        offers = frontier.join(held(steps), scope + ["src"]).select(
            *group,
            F.col("dst").alias("node"),
            label(F.col("_cost") + F.col("cost"), F.col("_hops") + 1, F.col("src"), F.col("edge_id")).alias("best"),
            F.lit(True).alias("fresh"),
        )
        # Known labels and offers combine map-side and meet in one shuffle; on equal labels the known
        # row (fresh = false) sorts first, so only true improvements travel on.
        known = best.withColumn("fresh", F.lit(False)).unionByName(offers)
        met = known.groupBy(*group, "node").agg(F.min(F.struct("best", "fresh")).alias("_m"))
        met = met.select(*group, "node", F.col("_m.best").alias("best"), F.col("_m.fresh").alias("fresh"))
        if whole_groups(steps):
            # A search that found nothing new is over: its labels stay where they are and are not met again.
            met = cut(met.withColumn("_on", F.max("fresh").over(Window.partitionBy(*group))))
            settled.append(met.filter("not _on").drop("_on"))
            best = met.filter("_on").drop("_on")
            if len(settled) > SETTLED_ROUNDS:
                # Their rounds hold labels of searches that went on, too; without them they can go.
                settled = [cut(reduce(DataFrame.unionByName, settled))]
        else:
            best = cut(met)
        if best.filter("fresh").isEmpty():
            done = reduce(DataFrame.unionByName, settled, best) if settled else best
            return done.select(*group, "node", "best.*")


def shortest_costs(steps: DataFrame, sources: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Cheapest cost and its hop count from every source to every node it reaches."""
    return shortest_tree(steps, sources, scope).select(*scope, "source", "node", "cost", "hops")


def least_costs(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """Cheapest cost from every source to every node it reaches, where neither hops nor predecessors are asked for.

    Costs alone combine by hash where the offers are made, without sorting them as whole labels, and of parallel steps only
    the cheapest is tried.
    """
    kind = steps.schema["cost"].dataType
    steps = cut(_sound(steps).groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    node_type = steps.schema["src"].dataType
    best = sources.select("source").distinct().withColumns(
        {"node": F.col("source").cast(node_type), "cost": F.lit(0).cast(kind), "fresh": F.lit(True)}
    )
    best = cut(best)
    none = F.lit(None).cast(kind)
    while True:
        frontier = best.filter("fresh").select("source", F.col("node").alias("src"), F.col("cost").alias("_cost"))
        offers = frontier.join(steps, "src").select(
            "source", F.col("dst").alias("node"), none.alias("known"), (F.col("_cost") + F.col("cost")).cast(kind).alias("offer")
        )
        known = best.select("source", "node", F.col("cost").alias("known"), none.alias("offer"))
        met = known.unionByName(offers).groupBy("source", "node").agg(F.min("known").alias("known"), F.min("offer").alias("offer"))
        # Only true improvements travel on, so equal-cost cycles end.
        fresh = F.coalesce(F.col("offer") < F.col("known"), F.col("offer").isNotNull())
        best = cut(met.select("source", "node", F.least("known", "offer").alias("cost"), fresh.alias("fresh")))
        if best.filter("fresh").isEmpty():
            return best.select("source", "node", "cost")


def path_steps(tree: DataFrame, requests: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Ordered steps of the chosen paths: requests(route_id, source, target) -> (route_id, ord, from, to, edge).

    Tables of 2^k-th predecessors are doubled up to the longest path, then every route is halved from the longest stretch
    down to single steps: twice as many rounds as that length has binary digits, whatever the number of hops.  ``tree`` is read
    in every round, so it should be materialised.
    """
    scope = list(scope)
    group = scope + ["source"]
    steps = tree.filter("hops > 0")
    asked = requests.select("route_id", *group, F.col("target").alias("node"))
    spans = cut(asked.join(held(steps.select(*group, "node", "hops")), group + ["node"]).withColumn("left", F.col("hops")))
    longest = spans.agg(F.max("hops")).first()[0] or 0
    jumps = [steps.select(*group, "node", "hops", F.col("pred").alias("back"))]
    while 2 ** len(jumps) < longest:
        half = 2 ** (len(jumps) - 1)
        # Only nodes with as many steps before them have a predecessor that far back.
        far = jumps[-1].filter(F.col("hops") >= 2 * half)
        onward = jumps[-1].select(*group, F.col("node").alias("back"), F.col("back").alias("_back"))
        jumps.append(cut(far.join(held(onward), group + ["back"]).select(*group, "node", "hops", F.col("_back").alias("back"))))
    for k in range(len(jumps) - 1, -1, -1):
        size = 2**k
        # A stretch longer than this one gives its last ``size`` steps and what lies before them.
        cuts = spans.filter(F.col("left") > size).join(held(jumps[k].drop("hops")), group + ["node"])
        parts = F.array(
            F.struct("node", "hops", F.lit(size).alias("left")),
            F.struct(F.col("back").alias("node"), (F.col("hops") - size).alias("hops"), (F.col("left") - size).alias("left")),
        )
        halves = cuts.select("route_id", *group, F.explode(parts).alias("_p")).select("route_id", *group, "_p.*")
        kept = spans.filter(F.col("left") <= size).select("route_id", *group, "node", "hops", "left")
        spans = cut(kept.unionByName(halves))
    return spans.drop("hops", "left").join(held(steps), group + ["node"]).select(
        "route_id",
        *group,
        F.col("hops").alias("ord"),
        F.col("pred").alias("from_node"),
        F.col("node").alias("to_node"),
        "edge_id",
        F.col("cost").alias("cost_so_far"),
    )


def cost_matrix(steps: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Cost of every ordered endpoint pair that is connected."""
    costs = least_costs(steps, endpoints.select(F.col("node_id").alias("source")))
    ends = endpoints.select(F.col("node_id").alias("node"))
    return (
        costs.join(ends, "node", "left_semi")
        .filter(F.col("source") != F.col("node"))
        .select(F.col("source").alias("start_node"), F.col("node").alias("end_node"), "cost")
    )


def selected_lengths(steps: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Paths chosen by ``cost`` but reported by their own ``length`` (penalised search, true distance)."""
    tree = shortest_tree(steps, endpoints.select(F.col("node_id").alias("source")))
    ends = endpoints.select(F.col("node_id").alias("target"))
    wanted = (
        tree.filter(F.col("hops") > 0)
        .join(ends, F.col("node") == F.col("target"), "left_semi")
        .select(F.concat_ws(">", "source", "node").alias("route_id"), "source", F.col("node").alias("target"))
    )
    lengths = steps.select("edge_id", F.col("src").alias("from_node"), "length")
    walked = path_steps(tree, wanted).join(lengths, ["edge_id", "from_node"])
    return walked.groupBy("route_id").agg(F.sum("length").alias("length")).join(wanted, "route_id")


def reachable(edges: DataFrame, roots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Nodes connected to the roots, every edge taken both ways whatever its direction flag."""
    scope = list(scope)
    both = F.array(
        F.struct(F.col("from_node").alias("src"), F.col("to_node").alias("dst")),
        F.struct(F.col("to_node").alias("src"), F.col("from_node").alias("dst")),
    )
    links = cut(edges.select(*scope, F.explode(both).alias("_e")).select(*scope, "_e.*").distinct())
    frontier = cut(roots.select(*scope, F.col("node_id").alias("node")).distinct())
    seen = frontier
    while not frontier.isEmpty():
        near = frontier.select(*scope, F.col("node").alias("src")).join(links, scope + ["src"])
        near = near.select(*scope, F.col("dst").alias("node")).distinct()
        frontier = cut(near.join(seen, scope + ["node"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def tree_detours(steps: DataFrame, root: DataFrame, endpoints: DataFrame, slack: float = 0.05, full: DataFrame | None = None) -> DataFrame:
    """Endpoint pairs whose cost grows beyond ``slack`` when only the root's shortest-path tree may be used; ``full`` is the
    cost matrix of the steps where it is there already."""
    steps = cut(steps.select("edge_id", "src", "dst", "cost"))
    tree = shortest_tree(steps, root.select(F.col("node_id").alias("source"))).filter(F.col("hops") > 0)
    used = tree.select("edge_id", F.col("pred").alias("src"), F.col("node").alias("dst"))
    forward = steps.join(used, ["edge_id", "src", "dst"], "left_semi")
    back = forward.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    pruned = forward.select("edge_id", "src", "dst", "cost").unionByName(back)
    full = cost_matrix(steps, endpoints) if full is None else full
    limited = cost_matrix(pruned, endpoints).withColumnRenamed("cost", "tree_cost")
    joined = full.join(limited, ["start_node", "end_node"], "left")
    worse = F.col("tree_cost").isNull() | (F.col("tree_cost") > F.col("cost") + slack)
    return joined.withColumn("worse", worse)


def via(matrix: DataFrame, trips: DataFrame) -> DataFrame:
    """Direct cost against the cost through a stop: trips(start_node, stop_node, end_node)."""
    def leg(a: str, b: str, name: str) -> DataFrame:
        return matrix.select(F.col("start_node").alias(a), F.col("end_node").alias(b), F.col("cost").alias(name))

    return (
        trips.join(leg("start_node", "end_node", "direct"), ["start_node", "end_node"])
        .join(leg("start_node", "stop_node", "first_leg"), ["start_node", "stop_node"])
        .join(leg("stop_node", "end_node", "second_leg"), ["stop_node", "end_node"])
        .withColumn("via_cost", F.col("first_leg") + F.col("second_leg"))
        .withColumn("ratio", F.try_divide(F.col("direct").cast("double"), F.col("via_cost").cast("double")))
    )


def special_vertices(links: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Endpoints plus every vertex whose number of distinct neighbours differs from two."""
    both = F.array(
        F.struct(F.col("from_node").alias("node_id"), F.col("to_node").alias("other")),
        F.struct(F.col("to_node").alias("node_id"), F.col("from_node").alias("other")),
    )
    degree = (
        links.select(F.explode(both).alias("_e"))
        .select("_e.*")
        .distinct()
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    return degree.filter(F.col("degree") != 2).select("node_id").union(endpoints.select("node_id")).distinct()


def contract_chains(links: DataFrame, special: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace every run of degree-two vertices by one edge with summed length and ordered vertices.

    ``links(from_node, to_node, length)`` is undirected.  Half-edges point at their predecessor and
    pointers double each round, so a chain of n vertices needs log2(n) joins; closed rings without a
    special vertex never resolve and drop out, as no chain starts there.  Returns the contracted edges
    and their vertices ``(start_node, first_node, ord, vertex)``, the start itself excluded.
    """
    both = F.array(
        F.struct(F.col("from_node").alias("a"), F.col("to_node").alias("b")),
        F.struct(F.col("to_node").alias("a"), F.col("from_node").alias("b")),
    )
    half = links.select(F.explode(both).alias("_e"), "length").select("_e.*", "length").distinct()
    special = special.select(F.col("node_id").alias("a")).withColumn("is_start", F.lit(True))
    half = cut(half.join(special, "a", "left").withColumn("is_start", F.coalesce("is_start", F.lit(False))))
    before = half.select(F.col("a").alias("_pa"), F.col("b").alias("a"))
    passing = (
        half.filter(~F.col("is_start"))
        .join(before, "a")
        .filter(F.col("_pa") != F.col("b"))
        .select("a", "b", "length", F.col("_pa").alias("pa"), F.col("a").alias("pb"))
    )
    zero = F.lit(0).cast("long")
    starts = half.filter("is_start").select("a", "b", "length", F.col("a").alias("ra"), F.col("b").alias("rb"), zero.alias("ord"))
    # Pointer rows: (a, b) sits ``ord`` half-edges after the half-edge (pa, pb).
    waiting = cut(passing.withColumn("ord", F.lit(1).cast("long")))
    settled = cut(starts)
    while not waiting.isEmpty():
        root = settled.select(
            F.col("a").alias("pa"), F.col("b").alias("pb"), "ra", "rb", F.col("ord").alias("_base")
        )
        arrived = cut(
            waiting.join(root, ["pa", "pb"]).select(
                "a", "b", "length", "ra", "rb", (F.col("ord") + F.col("_base")).alias("ord")
            )
        )
        if arrived.isEmpty():
            break
        settled = cut(settled.unionByName(arrived))
        rest = waiting.join(arrived.select("a", "b"), ["a", "b"], "left_anti")
        hop = rest.select(
            F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("_na"), F.col("pb").alias("_nb"),
            F.col("ord").alias("_step"),
        )
        # A pointer whose target has just settled stays as it is and arrives next round.
        waiting = cut(
            rest.join(hop, ["pa", "pb"], "left").select(
                "a", "b", "length", F.coalesce("_na", "pa").alias("pa"), F.coalesce("_nb", "pb").alias("pb"),
                (F.col("ord") + F.coalesce("_step", F.lit(0))).alias("ord"),
            )
        )
    chains = settled.groupBy("ra", "rb").agg(
        F.sum("length").alias("length"),
        F.count(F.lit(1)).alias("parts"),
        F.max_by(F.struct("a", "b"), "ord").alias("_end"),
    )
    ends = chains.select(
        F.col("ra").alias("start_node"),
        F.col("rb").alias("first_node"),
        F.col("_end.b").alias("end_node"),
        F.col("_end.a").alias("last_node"),
        "length",
        "parts",
    )
    # Each chain is met from both ends; keep the smaller reading.
    forward, backward = F.struct("start_node", "first_node"), F.struct("end_node", "last_node")
    kept = ends.filter(forward <= backward)
    vertices = settled.select(
        F.col("ra").alias("start_node"), F.col("rb").alias("first_node"), (F.col("ord") + 1).alias("ord"),
        F.col("b").alias("vertex"),
    )
    return kept, vertices.join(kept.select("start_node", "first_node"), ["start_node", "first_node"], "left_semi")
