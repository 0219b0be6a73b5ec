"""Packing of documents into fixed windows by minimum bin slack.

A document longer than the window gives full windows of its own; what remains of every document (its length modulo
the window) is packed.  The driver sees only how many remainders have each length, at most ``window - 1`` numbers
whatever the input.  For each window it takes the longest remainder left and fills the rest as closely as a bounded
subset sum over the other lengths can (a bitset of reachable sums, counts traced back), and repeats that multiset
while the counts last.  Documents find their places by their ordinal among the remainders of their length.

Defined cases: a null or empty text has the end id only; repeated rows and rows that share a ``doc_id`` are packed
one by one; a null ``doc_id`` stays null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concourse.llm.kernels import chunks
from concourse.llm.tables import stored
from concourse.llm.tokens import END_ID, default_path, word_tokens

WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded_batches(column: pa.Array, tokenizer_path: str) -> Iterator[tuple[int, list[bytes]]]:
    """``(first row, 16-bit ids of each text with the end id)`` for runs of whole texts."""
    tokens = word_tokens(tokenizer_path)
    end = np.array([END_ID], dtype="<u2").tobytes()
    for chunk in chunks(column):
        texts = [chunk.text(i) for i in range(chunk.rows)]
        tokens.learn(texts)
        yield chunk.first, [tokens.ids(text) + end for text in texts]


def crc_of(ids: bytes) -> int:
    """CRC-32 of 16-bit ids written as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def encoded_lengths(docs: DataFrame, tokenizer_path: str, window: int) -> DataFrame:
    """doc_id, doc_tokens, the checksum of each piece (full windows, then the remainder), and the task as ``slice``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in encoded_batches(batch.column(1), tokenizer_path):
                crcs = [[crc_of(ids[i : i + 2 * window]) for i in range(0, len(ids), 2 * window)] for ids in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)).cast(pa.int64()),
                        pa.array([len(ids) // 2 for ids in texts], pa.int64()),
                        pa.array(crcs, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "doc_tokens", "crcs"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(measure, "doc_id long, doc_tokens long, crcs array<long>").withColumn("slice", F.spark_partition_id())


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is as close to ``room`` as can be without passing it."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    picked: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            picked[length] = picked.get(length, 0) + take
            total -= length * take
    return picked


def slack_plan(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """``(times, multiset)`` pairs that use every remainder once, each multiset with as little slack as can be."""
    left = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = closest_fill({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, fill))
    return plan


def placements(plan: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per length: (first ordinal, end ordinal, copies in a window, first sequence, offset of the first copy)."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for times, fill in plan:
        offset = 0
        for length in sorted(fill, reverse=True):
            n = fill[length]
            first = used.get(length, 0)
            used[length] = first + n * times
            out.setdefault(length, []).append((first, used[length], n, sequence, offset))
            offset += n * length
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    rows = stored(encoded_lengths(docs, tokenizer_path or default_path(), window), "packing")
    rest = (F.col("doc_tokens") % window).cast("int")
    rows = rows.withColumn("rest", rest).withColumn("full", F.floor(F.col("doc_tokens") / window).cast("long"))
    # Ordinals among equal remainders, counted per slice first, so that one common length is never one task's.
    by_slice = rows.groupBy("slice", "rest").agg(F.count("*").alias("n"))
    counts = {r["rest"]: r["n"] for r in by_slice.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    counts.pop(0, None)
    plan = slack_plan(counts, window)
    shared = sum(times for times, _ in plan)
    kind = "rest int, places array<struct<first:long,end:long,copies:long,sequence:long,offset:long>>"
    places = spark.createDataFrame(sorted(placements(plan).items()), kind).coalesce(1)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_rest = Window.partitionBy("rest").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slice.select("slice", "rest", F.coalesce(F.sum("n").over(by_rest), F.lit(0)).alias("earlier"))
    fulls = rows.groupBy("slice").agg(F.sum("full").alias("n")).select(
        "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("full_before")
    )
    order = ["doc_id", "doc_tokens", "crcs"]
    in_slice = Window.partitionBy("slice")
    ranked = (
        rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("slice", "rest").orderBy(*order)) - 1)
        .withColumn("own", F.sum("full").over(in_slice.orderBy("rest", "ordinal").rowsBetween(Window.unboundedPreceding, -1)))
        .join(starts, ["slice", "rest"])
        .join(fulls, "slice")
        .join(places, "rest", "left")
        .withColumn("ordinal", F.col("ordinal") + F.col("earlier"))
    )
    place = F.element_at(F.filter("places", lambda p: (p["first"] <= F.col("ordinal")) & (F.col("ordinal") < p["end"])), 1)
    ranked = ranked.withColumn("place", place).withColumn("inside", F.col("ordinal") - F.col("place.first"))
    full_id = F.lit(shared) + F.col("full_before") + F.coalesce("own", F.lit(0))
    pieces = ranked.select(
        "doc_id", "doc_tokens", "rest", "full", "place", "inside", full_id.alias("full_id"), F.posexplode("crcs").alias("at", "ids_crc32")
    )
    whole = F.col("at") < F.col("full")
    copy = F.pmod(F.col("inside"), F.col("place.copies"))
    return pieces.select(
        "doc_id",
        (F.col("at") * F.lit(window)).cast("long").alias("start"),
        F.when(whole, F.lit(window)).otherwise(F.col("rest")).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(whole, F.col("full_id") + F.col("at"))
        .otherwise(F.col("place.sequence") + F.floor(F.col("inside") / F.col("place.copies")))
        .cast("long")
        .alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("place.offset") + copy * F.col("rest")).cast("long").alias("offset"),
    )
