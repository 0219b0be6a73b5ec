"""The corpus pipeline: each stage applies one operator to the documents that the stage before it kept.

Defined cases: a null text fails the quality rules; an empty table stays empty; rows that share a
``doc_id`` are told apart by a hash of the text in the near-duplicate stage, and equal ones count once; columns beyond those of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concourse.llm import decontaminate, jaccard, line_dedup, packing, quality_rules
from concourse.llm.tables import fresh, set_aside, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the fences of their language and source."""
    rows, back = set_aside(docs, [*quality_rules.COUNTS, *quality_rules.VERDICTS])
    return quality_rules.with_quality(rows).filter("kept").select(*rows.columns).withColumnsRenamed(back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line passages that an earlier document holds."""
    rows, back = set_aside(docs, list(line_dedup.ADDED))
    return line_dedup.dedup_lines(rows).select(*rows.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id, then hash of the text, of every group of linked documents."""
    key, version, nth = (fresh(c, docs.columns) for c in ("_key", "_version", "_nth"))
    rows = docs.withColumn(version, F.xxhash64(F.col("text").cast("string")))
    # Only rows whose doc_id stands for several texts need a name of their own.
    texts = rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(version).alias("_a"), F.max(version).alias("_z"))
    clashing = stored(texts.filter(F.col("_a") < F.col("_z")).select(F.col("doc_id").alias("_shared")), "clashing-ids")
    rows = rows.join(clashing, F.col("doc_id") == F.col("_shared"), "left")
    own_id = F.col("doc_id").cast("long")
    rows = rows.withColumn(key, F.when(F.col("_shared").isNotNull(), F.xxhash64("doc_id", version)).otherwise(own_id))
    marks = rows.filter(F.col("_shared").isNotNull()).select(F.col(key).alias("_named"), own_id.alias("_id"), F.col(version).alias("_version_of")).distinct()
    marks, rows = stored(marks, "named-rows"), rows.drop("_shared")
    groups = stored(jaccard.similar(rows.select(F.col(key).alias("doc_id"), "text")).select("doc_id", "component_id").distinct(), "components")
    placed = groups.join(marks, F.col("doc_id") == F.col("_named"), "left")
    mixed = placed.filter(F.col("_named").isNotNull()).select(F.col("component_id").alias("_mixed")).distinct()
    plain = groups.filter(F.col("component_id") < F.col("doc_id")).join(mixed, F.col("component_id") == F.col("_mixed"), "left_anti")
    # Own names are no ids, so the first of a group with such rows is found by their ids.
    place = F.struct(F.coalesce("_id", "doc_id").alias("id"), F.coalesce("_version_of", F.lit(0)).alias("version"), "doc_id")
    placed = placed.join(mixed, F.col("component_id") == F.col("_mixed")).withColumn("_place", place)
    first = placed.groupBy("_mixed").agg(F.min("_place").alias("_first"))
    later = placed.drop("_mixed").join(first, F.col("component_id") == F.col("_mixed")).filter(F.col("_place") != F.col("_first"))
    dropped = plain.select("doc_id").union(later.select("doc_id")).distinct().withColumnRenamed("doc_id", key)
    kept = rows.join(dropped, key, "left_anti")
    alone = F.when(F.col("doc_id").isNull(), F.col(version))
    same = Window.partitionBy(key, alone).orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    return kept.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document lies in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
