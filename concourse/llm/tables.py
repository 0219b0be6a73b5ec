"""Reading and shaping of the input tables of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from concourse.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Rename the columns of ``df`` that clash with ``names``; the second result renames them back."""
    clash = {c: fresh(c, [*df.columns, *names]) for c in df.columns if c.lower() in {n.lower() for n in names}}
    return df.withColumnsRenamed(clash), {new: old for old, new in clash.items()}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one all executors share; the caller names it when it wants to keep the files."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor replays nothing."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
