"""Removal of multi-line passages that repeat across the corpus.

A passage is a run of ``LEAST_LINES`` lines or more (blank ones count) with ``LEAST_BYTES`` bytes or more that are no
white space.  A line goes if it lies in any passage that stands at an earlier place too (smaller ``doc_id``, then place).
Every line of a passage lies in a smallest passage inside it: the shortest one from a given line on, or up to it.  These
follow from their own bytes alone, at most two per line, and meet by their hashes; the first of equal ones stays and
every other one goes once its bytes have been compared with those of the first.  No passage is missed, wherever it stands.

Defined cases: a null or empty text has nothing to remove and stays as it is; rows that share both ``doc_id`` and text
are one document here and are treated alike; rows that share only the ``doc_id`` are told apart by a hash of the text;
a null ``doc_id`` comes first; lines end at line feeds only; copies that overlap the first one go as well, up to the
lines it has before them; ``n_removed_chunks`` counts the separate runs of removed lines; an empty table gives an empty
result; other columns pass through, and those named like the added ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concourse.llm.kernels import Chunk, SubstringHash, WORD_BREAK, chunks, lines, signed
from concourse.llm.tables import stored

LEAST_LINES = 2
LEAST_BYTES = 40
ADDED = ("n_lines", "n_removed_lines", "n_removed_chunks")
#: Longer bodies are compared deflated: beside long stretches of blank lines, smallest passages overlap in most of their bytes.
PLAIN_BYTES = 4096
CHUNKS = "doc_id long, version long, low long, high long, first int, lines int, start long, bytes long"


def line_chunks(chunk: Chunk) -> dict[str, np.ndarray]:
    """All smallest passages: row, hashes of their bytes, first line, number of lines, first byte and length in bytes."""
    start, end, row = lines(chunk)
    hashes = SubstringHash(chunk.data)
    filled = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.cumsum(~WORD_BREAK[chunk.data], out=filled[1:])
    before, upto = filled[start], filled[end]
    n, at = len(row), np.arange(len(row))
    of_row = np.searchsorted(row, np.arange(chunk.rows))
    last = np.maximum(at + LEAST_LINES - 1, np.searchsorted(upto, before + LEAST_BYTES))
    first = np.minimum(at - LEAST_LINES + 1, np.searchsorted(before, upto - LEAST_BYTES, side="right") - 1)
    on, back = last < np.append(of_row[1:], n)[row], first >= of_row[row]
    both = np.unique(np.concatenate([at[on] * n + last[on], first[back] * n + at[back]]))
    first, ends = both // max(n, 1), both % max(n, 1)
    a, b = start[first], end[ends]
    return {
        "row": row[first],
        "low": signed(hashes.of(a, b)),
        "high": signed(SubstringHash(chunk.data, 1).of(a, b)),
        "first": (first - of_row[row[first]]).astype(np.int32),
        "lines": (ends - first + 1).astype(np.int32),
        "start": a - chunk.offsets[row[first]],
        "bytes": b - a,
    }


def _all_chunks(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = line_chunks(chunk)
                at = pa.array(found.pop("row") + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, found.values())],
                    names=["doc_id", "version", *found],
                )

    return rows.mapInArrow(cut, CHUNKS)


def _body(text: bytes, span: dict) -> bytes:
    body = text[span["start"] : span["start"] + span["bytes"]]
    return body if len(body) <= PLAIN_BYTES else zlib.compress(body, 1)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, version, first line and lines of every smallest passage to remove, after the byte comparison."""
    rows = _keyed(docs)
    found = stored(_all_chunks(rows), "line-chunks")
    place = F.struct("doc_id", "version", "first")
    groups = found.groupBy("low", "high", "bytes").agg(F.min(place).alias("keeper"), F.count("*").alias("n"))
    groups = groups.filter(F.col("n") > 1).drop("n")
    spans = found.join(groups, ["low", "high", "bytes"]).select(
        "doc_id", "version", F.struct("low", "high", "start", "bytes", "first", "lines", (place == F.col("keeper")).alias("keeps")).alias("span")
    )
    spans = spans.distinct().groupBy("doc_id", "version").agg(F.collect_list("span").alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    # Rows that share doc_id and text say the same twice; one of them is enough.
    held = rows.join(spans, same).select("doc_id", "version", "text", "spans")
    schema = "doc_id long, version long, low long, high long, first int, lines int, keeps boolean, body binary"

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                part = batch.slice(chunk.first, chunk.rows)
                spans = part.column(3).to_pylist()
                texts = [chunk.text(i) for i in range(chunk.rows)]
                at = pa.array([i for i, of in enumerate(spans) for _ in of], pa.int64())
                flat = [s for of in spans for s in of]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at),
                        part.column(1).take(at),
                        *(pa.array([s[c] for s in flat], k) for c, k in (("low", pa.int64()), ("high", pa.int64()), ("first", pa.int32()), ("lines", pa.int32()), ("keeps", pa.bool_()))),
                        pa.array([_body(text, s) for text, of in zip(texts, spans, strict=True) for s in of], pa.binary()),
                    ],
                    names=["doc_id", "version", "low", "high", "first", "lines", "keeps", "body"],
                )

    shown = held.mapInArrow(bodies, schema)
    keepers = shown.filter("keeps").groupBy("low", "high").agg(F.min("body").alias("kept_body"))
    equal = shown.filter(~F.col("keeps")).join(keepers, ["low", "high"]).filter(F.col("body") == F.col("kept_body"))
    return equal.select("doc_id", "version", "first", "lines").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("version"), text.alias("text"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages; adds n_lines, n_removed_lines and n_removed_chunks."""
    own = [c for c in docs.columns if c not in ADDED]
    drop = repeated_chunks(docs).groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "lines")).alias("_gone"))
    drop = drop.withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    rest = [c for c in own if c not in ("doc_id", "text")]
    carried = F.struct(*rest).alias("rest") if rest else F.lit(None).cast("string").alias("rest")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("version"), text.alias("text"), carried)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    joined = rows.join(drop, same, "left").select("doc_id", "text", "rest", "_gone")
    schema = joined.drop("_gone").schema
    for name in ADDED:
        schema = schema.add(name, "long")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                part = batch.slice(chunk.first, chunk.rows)
                texts = part.column(1)
                gone = part.column(3).to_pylist()
                fresh, counts = texts.to_pylist() if any(gone) else None, []
                for i, spans in enumerate(gone):
                    raw = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
                    n = int(np.count_nonzero(raw == 10)) + 1
                    gone_here = np.zeros(n + 1, dtype=bool)
                    for s in spans or ():
                        gone_here[s["first"] : s["first"] + s["lines"]] = True
                    counts.append((n, int(gone_here.sum()), int(np.count_nonzero(gone_here[:-1] & ~gone_here[1:]))))
                    if spans:
                        of = fresh[i].split("\n")
                        fresh[i] = "\n".join(of[j] for j in np.flatnonzero(~gone_here[:n]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), texts if fresh is None else pa.array(fresh, texts.type), part.column(2), *(pa.array([c[j] for c in counts], pa.int64()) for j in range(3))],
                    names=["doc_id", "text", "rest", *ADDED],
                )

    out = joined.mapInArrow(rewrite, schema)
    return out.select(*[c if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in own], *ADDED)


def removed_lines(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed_lines, n_removed_chunks and the hash of what stays."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", *ADDED, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
