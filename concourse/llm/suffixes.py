"""Removal of long byte strings that occur more than once, by prefix doubling on anchored positions.

Every ``LENGTH``-byte string holds one anchor, the place of its smallest ``GRAM``-byte hash, which depends on the
string alone; equal strings have their anchors at the same offset.  Starts are taken in blocks of ``BLOCK`` that are
aligned to the anchor, so the strings that start in a block share a core of ``CORE`` bytes.  Spark ranks the cores by
prefix doubling: a rank for the first piece, then for pairs of ranks at offsets that grow until the whole core is
covered; a block whose rank is unique goes.  Blocks that agree in their surroundings too are repeated as a whole; the
others are compared start by start, again by grouping, never in one task.  Found starts become byte spans per document.

Ranks and comparisons name byte strings by 64-bit hashes, two independent ones for each decision.

Defined cases: a null or empty text, or one shorter than ``LENGTH`` bytes, loses nothing; repeated rows repeat each
other's strings and are both removed; rows that share only the ``doc_id`` are told apart by a hash of the text; a null
``doc_id`` is an id like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.llm.kernels import Chunk, SubstringHash, chunks, mix, signed
from concourse.llm.tables import stored

LENGTH = 400
GRAM = 32
BLOCK = 128
CORE = LENGTH - BLOCK + 1
EDGE = BLOCK - 1
PIECES = (CORE // 4, CORE // 2, CORE)  # ends of the pieces that the rounds rank
_U64 = np.uint64


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values)
    if n < width:
        return np.empty(0, values.dtype)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def blocks(chunk: Chunk) -> dict[str, np.ndarray]:
    """All blocks of starts: row, first start (it may lie before the text), and the starts that exist in the text."""
    n, grams = len(chunk.data), len(chunk.data) - GRAM + 1
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return {"row": none, "base": none, "low": none, "high": none}
    at = np.arange(grams)
    hashes = SubstringHash(chunk.data).of(at, at + GRAM)
    key = (hashes & _U64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (sliding_least(key, LENGTH - GRAM + 1) & _U64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))
    inside = row[: len(anchor)] == row[LENGTH - 1 :]
    start, anchor = start[inside], anchor[inside]
    number = (anchor - start) // BLOCK
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1])
    start, anchor, number = start[fresh], anchor[fresh], number[fresh]
    base, of = anchor - BLOCK * number - (BLOCK - 1), row[start]
    # Blocks of two anchors can fall together; such a block is one.
    _, once = np.unique(of * (n + 2 * BLOCK) + base + BLOCK, return_index=True)
    base, of = base[once], of[once]
    low = np.maximum(base, chunk.offsets[of])
    high = np.minimum(base + BLOCK - 1, chunk.offsets[of + 1] - LENGTH)
    return {"row": of, "base": base, "low": low, "high": high}


ROWS = "doc_id long, version int, base long, skip int, count int, rank long, next1 long, next2 long, edge long"
SPANS = "doc_id long, version int, start long, end long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
HOT = 4096


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.hash(text).alias("version"), text.alias("text"))


def anchored(rows: DataFrame) -> DataFrame:
    """All blocks with the hashes of their core's pieces and of their surroundings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                b = blocks(chunk)
                at = pa.array(b["row"] + chunk.first)
                one, two = SubstringHash(chunk.data), SubstringHash(chunk.data, 1)
                core = b["base"] + EDGE
                cuts = [core, *(core + end for end in PIECES)]
                pieces = [one.of(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
                skip, count = b["low"] - b["base"], b["high"] - b["low"] + 1
                edge = mix(two.of(b["low"], b["high"] + LENGTH) ^ (skip * (2 * BLOCK) + count).astype(np.uint64))
                columns = [b["base"] - chunk.offsets[b["row"]], skip.astype(np.int32), count.astype(np.int32), *map(signed, pieces), signed(edge)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns)],
                    names=["doc_id", "version", "base", "skip", "count", "rank", "next1", "next2", "edge"],
                )

    return rows.mapInArrow(cut, ROWS)


def doubled(rows: DataFrame) -> DataFrame:
    """The blocks whose whole core occurs again: ranks of pieces, then of pairs of ranks, unique ones dropped each time."""
    for following in (None, "next1", "next2"):
        if following:
            rows = rows.withColumn("rank", F.xxhash64("rank", following)).drop(following)
        shared = rows.groupBy("rank").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("rank")
        rows = stored(rows.join(shared, "rank"), "ranks")
    return rows


def _same(id_column: str = "_id", version: str = "_version") -> Column:
    return F.col("doc_id").eqNullSafe(F.col(id_column)) & (F.col("version") == F.col(version))


def _per_document(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    grouped = rows.groupBy("doc_id", "version").agg(F.collect_list(F.struct(*columns)).alias(name))
    return grouped.withColumnsRenamed({"doc_id": "_id", "version": "_version"})


def edge_bytes(rows: DataFrame, open_blocks: DataFrame) -> DataFrame:
    """The bytes before and after the core of each open block, of which each start's string takes ``EDGE`` in a row."""
    wanted = _per_document(open_blocks, ["rank", "n", "base", "skip", "count"], "blocks")
    held = rows.join(wanted, _same()).select("doc_id", "version", "text", "blocks")
    schema = "rank long, n long, doc_id long, version int, base long, skip int, count int, edge binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = bytes(EDGE)
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                part = batch.slice(chunk.first, chunk.rows)
                found = part.column(3).to_pylist()
                at = pa.array([i for i, of in enumerate(found) for _ in of], pa.int64())
                edges = []
                for i, of in enumerate(found):
                    text = chunk.text(i)
                    for b in of:
                        base = b["base"]
                        before = text[max(base, 0) : base + EDGE]
                        after = text[base + LENGTH : base + LENGTH + EDGE]
                        edges.append(blank[: EDGE - len(before)] + before + after + blank[: EDGE - len(after)])
                flat = [b for of in found for b in of]
                kinds = {"rank": pa.int64(), "n": pa.int64(), "base": pa.int64(), "skip": pa.int32(), "count": pa.int32()}
                made = {k: pa.array([b[k] for b in flat], kind) for k, kind in kinds.items()}
                yield pa.RecordBatch.from_arrays(
                    [made["rank"], made["n"], part.column(0).take(at), part.column(1).take(at), made["base"], made["skip"], made["count"], pa.array(edges, pa.binary())],
                    names=["rank", "n", "doc_id", "version", "base", "skip", "count", "edge"],
                )

    return held.mapInArrow(cut, schema)


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _starts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Spans of the repeated starts among the blocks of whole ranks."""
    rank, base, skip, count = (batch.column(i).to_numpy() for i in (0, 4, 5, 6))
    n = batch.num_rows
    flat = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8)
    j = np.arange(BLOCK)
    begin = (np.arange(n) * (2 * EDGE))[:, None] + j
    key = SubstringHash(flat).of(begin.ravel(), begin.ravel() + EDGE).reshape(n, BLOCK)
    key = mix(key ^ mix(rank.view(np.uint64))[:, None] ^ mix(j.astype(np.uint64) + _U64(1))[None, :])
    exists = (j >= skip[:, None]) & (j < (skip + count)[:, None])
    again = np.zeros((n, BLOCK + 2), dtype=np.int8)
    again[:, 1:-1][exists] = _repeated(key[exists])
    change = np.diff(again, axis=1)
    row, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    at = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [batch.column(2).take(at), batch.column(3).take(at), pa.array(base[row] + first), pa.array(base[row] + last - 1 + LENGTH)],
        names=["doc_id", "version", "start", "end"],
    )


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole ranks at a time, from a stream sorted by rank."""
    held: pa.Table | None = None
    for batch in batches:
        for first in range(0, batch.num_rows, 4 * HOT):
            part = pa.Table.from_batches([batch.slice(first, 4 * HOT)])
            held = part if held is None else pa.concat_tables([held, part])
            ranks = held.column("rank").to_numpy()
            ready = int(np.searchsorted(ranks, ranks[-1]))
            if ready:
                yield _starts(held.slice(0, ready).combine_chunks().to_batches()[0])
                held = held.slice(ready)
    if held is not None and held.num_rows:
        yield _starts(held.combine_chunks().to_batches()[0])


def _hot_starts(edges: DataFrame) -> DataFrame:
    """The same for ranks with very many blocks: one row per start, grouped by what it covers."""
    one = edges.select("*", F.explode(F.sequence(F.col("skip"), F.col("skip") + F.col("count") - 1)).alias("j"))
    body = F.expr(f"substring(edge, j + 1, {EDGE})")
    one = one.select("doc_id", "version", "base", "j", "n", F.xxhash64("rank", "j", body).alias("k1"), F.xxhash64(body, "j", "rank").alias("k2"))
    twice = one.groupBy("k1", "k2").agg(F.sum("n").alias("times")).filter(F.col("times") > 1).drop("times")
    start = (F.col("base") + F.col("j")).cast("long")
    return one.join(twice, ["k1", "k2"]).select("doc_id", "version", start.alias("start"), (start + LENGTH).alias("end"))


def repeated_spans(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, version, start and end of repeated bytes; spans may overlap."""
    cores = doubled(anchored(rows))
    first = F.min(F.struct("doc_id", "version", "base", "skip", "count")).alias("first")
    kinds = cores.groupBy("rank", "edge").agg(F.count("*").alias("n"), first)
    several = kinds.groupBy("rank").agg(F.count("*").alias("k"))
    kinds = stored(kinds.join(several, "rank"), "surroundings")
    whole = cores.join(kinds.filter(F.col("n") > 1).select("rank", "edge"), ["rank", "edge"])
    start = F.col("base") + F.col("skip")
    whole = whole.select("doc_id", "version", start.alias("start"), (start + F.col("count") - 1 + LENGTH).alias("end"))
    open_blocks = kinds.filter(F.col("k") > 1).select("rank", "n", "k", "first.*")
    few = edge_bytes(rows, open_blocks.filter(F.col("k") <= hot))
    few = few.repartition("rank").sortWithinPartitions("rank").mapInArrow(_settle, SPANS)
    many = _hot_starts(edge_bytes(rows, open_blocks.filter(F.col("k") > hot)))
    return whole.union(few).union(many)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs."""
    rows = keyed(docs)
    spans = _per_document(repeated_spans(rows, hot), ["start", "end"], "spans")
    held = rows.join(spans, _same(), "left").select("doc_id", "version", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = [merged(s) for s in batch.column(3).slice(chunk.first, chunk.rows).to_pylist()]
                digests = []
                for i, runs in enumerate(found):
                    text, digest, at = chunk.text(i), hashlib.sha256(), 0
                    for start, end in runs:
                        digest.update(text[at:start])
                        at = end
                    digest.update(text[at:])
                    digests.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.rows),
                        pa.array(np.diff(chunk.offsets)),
                        pa.array([sum(b - a for a, b in runs) for runs in found], pa.int64()),
                        pa.array([len(runs) for runs in found], pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array([[{"start": a, "end": b} for a, b in runs] for runs in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
                )

    return held.mapInArrow(remove, RESULT + ", removed array<struct<start:long,end:long>>")
