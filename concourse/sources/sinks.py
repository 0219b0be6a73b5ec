"""Deterministic output."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_rows(df: DataFrame) -> DataFrame:
    """Distinct rows in the order of their JSON text, which is added as ``record``."""
    record = F.to_json(F.struct(*df.columns))
    return df.withColumn("record", record).dropDuplicates(["record"]).orderBy("record")


def write_stable(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "json") -> None:
    """Range-sorted files with fixed column order and no timestamps; equal input gives equal bytes.

    ``orderBy`` shuffles by range, so the order holds across files in name order.
    """
    ordered = df.select(*sorted(df.columns)).orderBy(*keys)
    writer = ordered.write.mode("errorifexists")
    (writer.option("ignoreNullFields", "false").json(path) if fmt == "json" else writer.parquet(path))


def _file_system(root: str) -> tuple[pa.fs.FileSystem, str]:
    if root.startswith(("/", "file:")):
        return pa.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", root)
    return pa.fs.FileSystem.from_uri(root)


def write_named(files: DataFrame, root: str) -> None:
    """One file per row below ``root``, which all executors share; files: name (relative path), content (binary or text).

    A file appears under its name once it is whole, and a task run again writes the same bytes to the same name.  Names
    have to be distinct.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(root)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = posixpath.join(base, name)
                folder = posixpath.dirname(target)
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = posixpath.join(folder, f".{uuid.uuid4().hex}")
                with fs.open_output_stream(draft) as sink:
                    sink.write(content)
                fs.move(draft, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
