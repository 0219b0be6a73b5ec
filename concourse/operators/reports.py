"""Reconciliation reports: one-row summaries and labelled checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.operators import measures as ms
from concourse.operators import relational as rl


def one_row(**parts: DataFrame) -> DataFrame:
    """Single-value aggregates side by side: each part is a one-row, one-column frame."""
    names = list(parts)
    first = parts[names[0]]
    head = first.select(F.col(first.columns[0]).alias(names[0]))
    return head.select(names[0], *[parts[n].scalar().alias(n) for n in names[1:]])


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def checks(*labelled: tuple[str, DataFrame, Column]) -> DataFrame:
    """Rows (label, passed, failed_rows): each check holds when no row of its frame breaks the condition."""
    out = None
    for label, df, ok in labelled:
        row = df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed_rows")).select(
            F.lit(label).alias("label"), (F.col("failed_rows") == 0).alias("passed"), "failed_rows"
        )
        out = row if out is None else out.unionByName(row)
    return out


def network_report(
    nodes: DataFrame, edges: DataFrame, areas: DataFrame, walls: DataFrame, reached: DataFrame, reached_places: DataFrame, contacts: DataFrame, outside: DataFrame, crossings: DataFrame
) -> DataFrame:
    """Sizes, reached places, their ordered pairs (once all nodes are reached) and the numbers of geometry faults, in one row."""
    row = one_row(
        nodes=counted(nodes),
        edges=counted(edges),
        areas=counted(areas),
        walls=counted(walls),
        _reached=counted(reached),
        reached_places=counted(reached_places),
        wall_contacts=counted(contacts),
        area_failures=counted(outside),
        interior_crossings=counted(crossings),
    )
    pairs = F.when(F.col("_reached") == F.col("nodes"), F.col("reached_places") * (F.col("reached_places") - 1))
    return row.withColumn("ordered_pairs", pairs).drop("_reached")


def ingest_validation(changed: DataFrame, kept: DataFrame, overlap: DataFrame, anchors: DataFrame, schedule: DataFrame) -> DataFrame:
    """Hash agreement, kept paths, coincident geometry, largest anchor residual and schedule size."""
    row = one_row(
        changed_files=counted(changed),
        kept_paths=counted(kept),
        overlap=counted(overlap),
        max_residual=anchors.agg(F.max("residual")),
        schedule_rows=counted(schedule),
    )
    return row.withColumn("hashes_match", F.col("changed_files") == 0)


def semantic_verify(places: DataFrame) -> DataFrame:
    """Inventory size, distinct ids, outlines present and unresolved; places: place_id, geometry_status."""
    ids = places.agg(F.count_distinct("place_id").alias("unique_ids"))
    return ms.geometry_summary(places).select(
        F.col("places").alias("inventory"), ids.scalar().alias("unique_ids"), F.col("with_outline").alias("valid_outlines"), F.col("unresolved").alias("unresolved_outlines")
    )


def topology(compared: DataFrame, nodes: DataFrame, edges: DataFrame, detours: DataFrame | None = None, trip: DataFrame | None = None) -> DataFrame:
    """Pairs, largest cost ratio, failures and independent cycles; with ``detours`` how many pairs a rooted tree would worsen,
    with ``trip`` (one row of ``network.via``, or none) its direct cost beside the cost through the stop."""
    both_ways = F.struct(F.least("start_node", "end_node"), F.greatest("start_node", "end_node"))
    row = one_row(
        pairs=counted(compared),
        unordered_pairs=compared.agg(F.count_distinct(both_ways)),
        max_ratio=compared.agg(F.max("ratio")),
        failures=compared.agg(F.count_if("failed")),
        cycles=ms.cycle_rank(nodes, edges).select("cycles"),
        **({"tree_worse": detours.agg(F.count_if("worse"))} if detours is not None else {}),
        **({"trip_direct": trip.agg(F.max("direct")), "trip_via": trip.agg(F.max("via_cost"))} if trip is not None else {}),
    )
    return row


def review_rows(places: DataFrame, labels: DataFrame, door_gaps: DataFrame) -> DataFrame:
    """Evidence per place: sorted label ids and nearby door gaps beside status, area, conflict and reason.

    Both lists are deduplicated before they are gathered.
    """
    def gathered(df: DataFrame, key: str, item: str, name: str) -> DataFrame:
        return df.select(key, item).distinct().groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))

    out = places.join(gathered(labels, "place_id", "label_id", "label_ids"), "place_id", "left")
    return out.join(gathered(door_gaps, "place_id", "door_id", "door_ids"), "place_id", "left")


def conflicts(schedule: DataFrame, labels: DataFrame) -> DataFrame:
    """Schedule names against plan names of the same number; differences are kept, never resolved."""
    joined = schedule.join(labels, "number")
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return joined.filter(plain("schedule_name") != plain("plan_name"))


def source_truth(places: DataFrame, overrides: DataFrame, refs_lost: DataFrame, drift: DataFrame) -> DataFrame:
    """Labelled assertions over the inventory with pass flags."""
    nothing = F.lit(False)
    return checks(
        ("every id is present", places, F.col("place_id").isNotNull()),
        ("every name is filled", places, F.length(F.trim("name_en")) > 0),
        ("codes are unique", rl.duplicates(places, "code"), nothing),
        ("outline matches its evidence", places, (F.col("geometry_status") == "unknown") == F.col("area").isNull()),
        ("overrides name known places", rl.fk_violations(overrides, places.select(F.col("place_id").alias("known_id")), [("place_id", "known_id")]), nothing),
        ("evidence resolves", refs_lost, nothing),
        ("coordinates were moved once", drift, nothing),
    )
