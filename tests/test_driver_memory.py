"""Tables that look small to Spark and are not stay out of the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators.search import Directory
from concourse.session import FEW_ROWS


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _directory(spark, aliases: int) -> Directory:
    names = F.transform(F.sequence(F.lit(1), F.lit(aliases)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    one = spark.range(1).select(
        F.col("id").alias("place_id"), F.col("id").alias("ord"), F.lit("C 1").alias("code"), F.lit("ring").alias("name_en"), F.lit("bolt").alias("name_ar"), names.alias("aliases")
    )
    return Directory(one)


def test_exploded_rows_are_not_broadcast(spark):
    """One row of the source gives more rows than a broadcast may have."""
    grown = _directory(spark, FEW_ROWS + 1)
    assert "Broadcast" not in _plan(grown.tokens.join(grown.fields, "place_id"))


def test_few_rows_are_broadcast(spark):
    small = _directory(spark, 3)
    assert "BroadcastHashJoin" in _plan(small.tokens.join(small.fields, "place_id"))
