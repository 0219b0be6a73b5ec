"""Token ids as Arrow stream files of equal-length sequences.

A shard is one stream file of record batches with two fixed-size-list columns: ``ids`` (16-bit) and ``mask`` (true for
real ids, false for the padding of the shard's last sequence).  A memory-mapped reader gets any sequence and its mask
as a view, without a copy.  A second stream file beside it names the documents and their lengths.  Shards follow
``doc_id``: their bounds are quantiles of it, so only that many numbers reach the driver.  A task writes a shard under
a name of its own and moves it into place, so a repeated task leaves the same files.

Defined cases: a null or empty text is the end id alone; rows that share a ``doc_id`` are ordered by text and repeated
rows are written again; a null ``doc_id`` comes first; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concourse.llm.packing import encoded_batches
from concourse.llm.tables import stored
from concourse.llm.tokens import default_path

SEQUENCE = 2048
BATCH = 64
MANIFEST = "shard long, path string, docs long, tokens long, sequences long"


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder that all executors share."""
    if re.match(r"file:/|/", uri):
        return pa.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """One shard: ids gathered into sequences, a batch written whenever it is full."""

    def __init__(self, folder: str, shard: int, length: int, rows: int):
        self.fs, root = place(folder)
        self.fs.create_dir(root, recursive=True)
        self.shard, self.length, self.rows = shard, length, rows
        self.path = f"{folder}/shard-{shard:08d}"
        self.target = f"{root}/shard-{shard:08d}"
        self.draft = f"{root}/.draft-{shard:08d}-{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(f"{self.draft}.arrow")
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[bytes] = []
        self.size = self.tokens = self.sequences = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 2)
        self.held.append(ids)
        self.size += len(ids) // 2
        if self.size >= self.length * self.rows:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u2")
        full = len(ids) // self.length
        stop = len(ids) if last else full * self.length
        for start in range(0, stop, self.length * self.rows):
            part = ids[start : min(start + self.length * self.rows, stop)]
            n = -(-len(part) // self.length)
            padded = np.zeros(n * self.length, dtype="<u2")
            padded[: len(part)] = part
            mask = np.arange(n * self.length) < len(part)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.sequences += n
        self.tokens += stop
        self.held = [ids[stop:].tobytes()]
        self.size = len(ids) - stop

    def close(self) -> tuple[int, str, int, int, int]:
        self._write(True)
        self.out.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "tokens": pa.array(self.lengths, pa.int64())})
        with self.fs.open_output_stream(f"{self.draft}.docs") as sink, pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        for kind in ("arrow", "docs"):
            self.fs.move(f"{self.draft}.{kind}", f"{self.target}.{kind}")
        return self.shard, self.path, len(self.lengths), self.tokens, self.sequences


class SequenceFile:
    """Random access to the sequences of one local shard; arrays are views of the mapped file."""

    def __init__(self, path: str):
        self.map = pa.memory_map(f"{place(path)[1]}.arrow")
        self.batches = list(pa.ipc.open_stream(self.map))
        self.first = np.cumsum([0, *(b.num_rows for b in self.batches)]).tolist()

    def __len__(self) -> int:
        return self.first[-1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = bisect.bisect_right(self.first, i) - 1
        batch, row = self.batches[at], i - self.first[at]
        ids, mask = batch.column(0), batch.column(1)
        n = ids.type.list_size
        return ids.values.slice((ids.offset + row) * n, n).to_numpy(zero_copy_only=True), mask.values.slice((mask.offset + row) * n, n)


def write_sequences(docs: DataFrame, folder: str, tokenizer_path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Write every document's ids below ``folder``; returns the manifest, one row per shard."""
    spark = docs.sparkSession
    path = tokenizer_path or default_path()
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shares = [i / shards for i in range(1, shards)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 20 * shards).alias("b")).first()["b"] or []
    edges = F.split(F.lit(",".join(map(str, sorted(set(bounds))))), ",").cast("array<long>") if bounds else F.array().cast("array<long>")
    shard = F.size(F.filter(edges, lambda b: b < F.col("doc_id"))).cast("long")
    rows = rows.withColumn("shard", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(shard))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out = [], None
        for batch in batches:
            numbers = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            for first, texts in encoded_batches(batch.column(1), path):
                for i, text in enumerate(texts, first):
                    if out is None or out.shard != numbers[i]:
                        if out is not None:
                            done.append(out.close())
                        out = ShardWriter(folder, numbers[i], sequence, BATCH)
                    out.add(ids[i], text)
        if out is not None:
            done.append(out.close())
        columns = zip(*done, strict=True) if done else [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["shard", "path", "docs", "tokens", "sequences"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return stored(rows.select("doc_id", "text", "shard").mapInArrow(write, MANIFEST), "manifest")


def _documents(path: str, before: int) -> Iterator[tuple[int | None, int, int, int]]:
    """doc_id, start, n_tokens and checksum of each document, read from a shard's two files."""
    fs, root = place(path)

    def stream(kind: str):
        if isinstance(fs, pa.fs.LocalFileSystem):
            return pa.ipc.open_stream(pa.memory_map(f"{root}.{kind}"))
        return pa.ipc.open_stream(fs.open_input_stream(f"{root}.{kind}"))

    def runs() -> Iterator[np.ndarray]:
        for batch in stream("arrow"):
            ids = batch.column(0).flatten().to_numpy()
            mask = batch.column(1).flatten()
            yield ids if mask.true_count == len(ids) else ids[: mask.true_count]  # padding only ends a shard

    source, run, start = runs(), np.empty(0, "<u2"), before
    for index in stream("docs"):
        for doc_id, n in zip(index.column(0).to_pylist(), index.column(1).to_pylist(), strict=True):
            left, crc = n, 0
            while left:
                if not len(run):
                    run = next(source)
                part, run = run[:left], run[left:]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                left -= len(part)
            yield doc_id, start, n, crc
            start += n


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("before"))
    placed = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                columns = list(zip(*_documents(path, before), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
