"""Connected components of a link table by least labels and pointer jumping, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concourse.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) for every node of ``links`` (columns a, b)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter(F.col("a") != F.col("b")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        # The label of the label: chains shrink by half a round.
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = lower.join(hop, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        moved = stored(moved, "labels")
        changed = moved.filter(F.col("label") < F.col("old")).limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
