"""Fill-in-the-middle rewriting of whole texts, cut at line ends.

A text is a row of units, its lines with their line feed.  Where units end is kept in a compressed set of byte offsets
(:class:`Boundaries`): one container for each 65,536 offsets, a sorted array, a bitmap or a list of runs, whichever is
smallest, and how many members the containers before it hold.  The end of unit ``k`` is found by a search among those
counts and a select inside one container, so a very long text is cut by two look-ups and never walked.

Two draws per document choose the cuts, one whether it is rewritten and one in which order; all come from the digest of a
seed and the ``doc_id``, so that a task run again gives the same rows.  The order of the parts is ``psm`` (prefix, suffix,
middle) or ``spm``; each part follows its mark.  A text that holds a mark stays ``plain``, so every output can be undone.

Defined cases: a null text is an empty one; an empty text is plain; a null ``doc_id`` draws as an empty id; rows with one
``doc_id`` draw alike; an empty table gives an empty result; columns named like the added ones are replaced, others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.llm.kernels import Chunk, chunks

SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class ArrayContainer:
    """Few members: the members themselves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """Many scattered members: one bit each, with the number of members before each word of 64 bits."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[low] = 1
        self.bits = np.packbits(bits, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1))[:-1]]).astype(np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bits[8 * word : 8 * word + 8], bitorder="little"))
        return 64 * word + int(inside[k - self.before[word]])


class RunContainer:
    """Members side by side: the first of each run, and the number of members before it."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start, self.before = low[first].astype(np.uint16), first.astype(np.int64)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form of these ascending members below ``SPAN``."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(low) != 1]))
    if 4 * len(first) < min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low, first)
    return ArrayContainer(low) if 2 * len(low) <= BITMAP_BYTES else BitmapContainer(low)


class Boundaries:
    """An ascending set of offsets that answers which one is the k-th."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(offsets) else np.empty(0, np.int64)
        self.high, self.before, self.size = high[first], first, len(offsets)
        ends = np.append(first[1:], len(offsets)) if len(first) else first
        self.containers = [container(offsets[a:b] & (SPAN - 1)) for a, b in zip(first, ends, strict=True)]

    def select(self, k: int) -> int:
        """The member with ``k`` smaller ones."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.high[at]) * SPAN + self.containers[at].select(k - int(self.before[at]))

    def cut(self, units: int) -> int:
        """The offset after so many units."""
        return self.select(units - 1) if units else 0


def unit_ends(data: np.ndarray) -> Boundaries:
    """Ends of the lines of one text; the last one need not end with a line feed."""
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    return Boundaries(ends)


@dataclass(frozen=True)
class Layout:
    """Marks of the three parts, the share of texts to rewrite and of those to put the suffix first (in percent), and the seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rewritten: int = 100
    suffix_first: int = 50
    seed: str = "7"


def _code_points(part: np.ndarray) -> int:
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def _rewrite(chunk: Chunk, ids: list[str | None], layout: Layout) -> list[tuple]:
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in (layout.prefix, layout.suffix, layout.middle))
    out = []
    for i, doc_id in enumerate(ids):
        data = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
        text, ends = data.tobytes(), unit_ends(data)
        digest = hashlib.sha256(f"{layout.seed}:{doc_id or ''}".encode()).hexdigest()
        one, two, whether, order = (int(digest[j : j + 8], 16) for j in (0, 8, 16, 24))
        if not text or whether % 100 >= layout.rewritten or prefix_mark in text or suffix_mark in text or middle_mark in text:
            out.append((ends.size, "plain", None, None, text))
            continue
        units = sorted((one % (ends.size + 1), two % (ends.size + 1)))
        a, b = ends.cut(units[0]), ends.cut(units[1])
        head, body, tail = prefix_mark + text[:a], middle_mark + text[a:b], suffix_mark + text[b:]
        form = "spm" if order % 100 < layout.suffix_first else "psm"
        joined = tail + head + body if form == "spm" else head + tail + body
        out.append((ends.size, form, _code_points(data[:a]), _code_points(data[a:b]), joined))
    return out


def transform(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``docs`` with the number of units, the form, the code points of prefix and middle, and the rewritten text."""
    own = [c for c in docs.columns if c.lower() not in ADDED]
    held = F.struct(*own).alias("held")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), held)
    schema = rows.select("held").schema
    for name, kind in zip(ADDED, ("long", "string", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                part = batch.slice(chunk.first, chunk.rows)
                made = _rewrite(chunk, part.column(0).to_pylist(), layout)
                columns = [pa.array([m[j] for m in made], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(2), *columns], names=["held", *ADDED])

    out = rows.mapInArrow(rewrite, schema)
    return out.select(*[F.col("held")[c].alias(c) for c in own], *ADDED)


def restored(output: Column, form: Column, layout: Layout = Layout()) -> Column:
    """The text that an output of this form was made from."""

    def between(first: str, then: str) -> Column:
        start = F.instr(output, first) + len(first)
        return F.substr(output, start, F.instr(output, then) - start)

    def after(mark: str) -> Column:
        return F.substr(output, F.instr(output, mark) + len(mark))

    middle = after(layout.middle)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(between(layout.prefix, layout.suffix), middle, between(layout.suffix, layout.middle)))
        .otherwise(F.concat(between(layout.prefix, layout.middle), middle, between(layout.suffix, layout.prefix)))
    )
