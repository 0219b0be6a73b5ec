"""Reference checks, reconciliation and set comparison between keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions.geometry import norm


def fk_violations(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(on)])
    cond = None
    present = None
    for i, (c, _) in enumerate(on):
        match, known = F.col(c) == F.col(f"_p{i}"), F.col(c).isNotNull()
        cond = match if cond is None else cond & match
        present = known if present is None else present & known
    return child.filter(present).join(keys, cond, "left_anti")


def orphans(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parent rows no child refers to."""
    used = child.select(F.col(child_key).alias("_used"))
    return parent.join(used, F.col(parent_key) == F.col("_used"), "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def reciprocal_violations(
    places: DataFrame, nodes: DataFrame, allowed_types: Sequence[str] = ("door",)
) -> DataFrame:
    """Places whose door node is missing, of a wrong type, or does not point back to them on their floor.

    places: place_id, floor_id, door_node; nodes: node_id, room_id, node_floor, node_type.
    """
    linked = places.filter("door_node is not null").join(nodes, F.col("door_node") == F.col("node_id"), "left")
    agrees = (
        F.col("node_type").isin(list(allowed_types))
        & F.col("room_id").eqNullSafe(F.col("place_id"))
        & F.col("node_floor").eqNullSafe(F.col("floor_id"))
    )
    return linked.filter(~F.coalesce(agrees, F.lit(False)))


def trace_evidence(refs: DataFrame, raw: DataFrame, allowed: Column | None = None) -> DataFrame:
    """References ``file#id`` that resolve to no raw record (of an allowed layer).

    refs needs ``ref``; raw needs file, record_id and whatever ``allowed`` reads.
    """
    parts = F.split("ref", "#", 2)
    asked = refs.withColumn("file", F.get(parts, F.lit(0))).withColumn("record_id", F.get(parts, F.lit(1)))
    known = raw.filter(allowed) if allowed is not None else raw
    return asked.join(known.select("file", "record_id"), ["file", "record_id"], "left_anti")


def recompute_diff(
    stored: DataFrame, computed: DataFrame, keys: Sequence[str], xy: tuple[str, str], tol: float, name: str | None = None
) -> DataFrame:
    """Rows whose recomputed position (or name) drifts beyond ``tol``, or that one side lacks."""
    x, y = xy
    other = computed.select(
        *keys, F.col(x).alias("_x"), F.col(y).alias("_y"), *([F.col(name).alias("_name")] if name else []), F.lit(1).alias("_right")
    )
    joined = stored.withColumn("_left", F.lit(1)).join(other, list(keys), "full")
    drift = norm(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))
    renamed = ~F.col(name).eqNullSafe(F.col("_name")) if name else F.lit(False)
    missing = F.col("_left").isNull() | F.col("_right").isNull()
    out = joined.withColumn("drift", drift).filter(missing | (F.col("drift") >= tol) | renamed)
    return out.select(*keys, "drift", missing.alias("missing"))


def cost_vs_reference(matrix: DataFrame, reference: DataFrame, slack: float = 0.05) -> DataFrame:
    """Cost per pair beside its reference cost, their ratio, and whether the pair fails the slack."""
    ref = reference.withColumnRenamed("cost", "reference_cost")
    joined = ref.join(matrix, ["start_node", "end_node"], "left")
    ratio = F.try_divide(F.col("cost").cast("double"), F.col("reference_cost").cast("double"))
    failed = F.col("cost").isNull() | (F.col("cost") > F.col("reference_cost") + slack)
    return joined.withColumn("ratio", ratio).withColumn("failed", failed)


def max_ratio(compared: DataFrame) -> DataFrame:
    return compared.agg(F.max("ratio").alias("max_ratio"), F.count_if("failed").alias("failures"))


def pair_coverage(matrix: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Ordered endpoint pairs expected, connected and missing; counted, never enumerated."""
    expected = endpoints.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("pairs"))
    connected = matrix.agg(F.count(F.lit(1)).alias("connected"))
    return expected.select("pairs", connected.scalar().alias("connected")).withColumn(
        "missing", F.col("pairs") - F.col("connected")
    )


def snapshot_diff(before: DataFrame, after: DataFrame, name: str = "name", digest: str = "digest") -> DataFrame:
    """Names whose digest changed, appeared or vanished between two snapshots."""
    a = before.select(name, F.col(digest).alias("before_digest"), F.lit(1).alias("_b"))
    z = after.select(name, F.col(digest).alias("after_digest"), F.lit(1).alias("_a"))
    joined = a.join(z, name, "full")
    change = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(~F.col("before_digest").eqNullSafe(F.col("after_digest")), "changed")
    )
    return joined.select(name, change.alias("change")).filter("change is not null")


def symmetric_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, multiplicity kept, tagged by side; one signed count gives both sides."""
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    surplus = both.groupBy(*left.columns).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
    side = F.when(F.col("_n") > 0, F.lit("left")).otherwise(F.lit("right"))
    times = F.sequence(F.lit(1).cast("long"), F.abs("_n"))
    return surplus.select(*left.columns, side.alias("side"), F.explode(times).alias("_i")).drop("_i")


def signature_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct signatures present on both sides."""
    return a.select("signature").intersect(b.select("signature"))


def used_edges(paths: DataFrame) -> DataFrame:
    """Distinct undirected edges of all walked steps."""
    low, high = F.least("from_node", "to_node"), F.greatest("from_node", "to_node")
    return paths.select(low.alias("low_node"), high.alias("high_node")).distinct()


def inconsistent_groups(df: DataFrame, key: str, name: str, members: str) -> DataFrame:
    """Groups recorded with more than one name or more than one *set* of members."""
    version = F.struct(F.col(name), F.array_sort(F.array_distinct(members)))
    return df.groupBy(key).agg(F.count_distinct(version).alias("versions")).filter("versions > 1")


NUMBER_BLOCK = 65536


def sequence_gaps(codes: DataFrame, last: int | DataFrame) -> DataFrame:
    """Numbers 1..last that are missing, repeated, beyond the range or out of order.

    codes: ord (position) and number; the position rule compares each number with its 1-based place.  ``last`` is a number
    or one row with a column ``last``; the numbers up to it are made in blocks, by many tasks.
    """
    one = last if isinstance(last, DataFrame) else codes.sparkSession.range(1).select(F.lit(last).cast("long").alias("last"))
    upto = F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / NUMBER_BLOCK))
    blocks = one.filter("last > 0").select("last", F.explode(upto).alias("block")).repartition("block")
    first = F.col("block") * NUMBER_BLOCK
    expected = blocks.select(F.explode(F.sequence(first + 1, F.least(first + NUMBER_BLOCK, F.col("last")))).alias("number"))
    seen = codes.groupBy("number").agg(F.count(F.lit(1)).alias("copies"), F.min("ord").alias("first_ord"))
    joined = expected.withColumn("_want", F.lit(1)).join(seen, "number", "full")
    problem = (
        F.when(F.col("copies").isNull(), "missing")
        .when(F.col("_want").isNull(), "unexpected")
        .when(F.col("copies") > 1, "repeated")
        .when(F.col("first_ord") + 1 != F.col("number"), "out of order")
    )
    return joined.select("number", problem.alias("problem")).filter("problem is not null")


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Digest of every artifact against the manifest; files: name, content; manifest: name, digest."""
    actual = files.select("name", F.sha2(F.col("content"), 256).alias("digest"))
    return snapshot_diff(manifest, actual)
