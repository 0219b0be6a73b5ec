"""Maximal periodic runs of words within a text, and their collapse to one period.

A run is a stretch of words that repeats itself ``q`` words further on, is at least ``max(least, 2 * q)`` words long and
cannot grow; ``q`` is its smallest period.  Such a stretch agrees with itself over at least ``max(least - q, q)`` words of
the diagonal ``q``, so it holds a whole gram of about half that many words which starts at a multiple of the gram's width.
Lags are taken in classes that double, and so do the grams: the ranks of a class's grams come from pairs of ranks of the
class before.  All grams of a text are indexed by rank and place; each seed (a gram at a multiple of the width) meets the
places of its own rank at the lags of its class, one slice of the index.  Seeds that follow each other on a diagonal are
one chain: what is covered up to the furthest seed of a lag is not extended again.  Only the two ends of a chain grow, by
looking at ever shorter ranks.  Every step is exact; no hash stands for a word.

A seed has no more partners in a class than the class has lags for each word of its gram, so the work is in proportion to
the words for every class, also where one word fills the whole text; classes end when no gram repeats in its text.

Defined cases: a null or empty text has no words and no runs, and stays empty once collapsed; equal rows are treated
alike, ids play no part; texts of any length are whole (about 4 bytes a word and class); an empty table gives an empty
result; columns named like the added ones are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concourse.llm.kernels import WORD_BREAK, Chunk, chunks, words

LEAST = 12
ADDED = ("n_words", "runs", "collapsed")
MADE = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
COPY_BYTES = 4 << 20


def pair_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, and for no others."""
    if not len(first):
        return np.empty(0, np.int32)
    _, rank = np.unique(first.astype(np.int64) * (int(second.max()) + 1) + second, return_inverse=True)
    return rank.astype(np.int32)


def word_ranks(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words of one text; words of different texts differ."""
    letters = np.ascontiguousarray(chunk.data[~WORD_BREAK[chunk.data]])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return pair_ranks(row, column.dictionary_encode().indices.to_numpy())


def _at(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ranks[np.clip(places, 0, len(ranks) - 1)]


def _agreeing(levels: list[tuple[int, np.ndarray]], single: int, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
    """How many words agree after (or before) x and y, as far as one gram of each level and ``single`` words go."""
    gone = np.zeros(len(x), dtype=np.int64)
    for width, ranks in reversed(levels):
        for _ in range(single if width == 1 else 1):
            a, b = (x + gone, y + gone) if forward else (x - gone - width, y - gone - width)
            good = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(ranks)) & (_at(ranks, a) == _at(ranks, b))
            gone += np.where(good, width, 0)
    return gone


def _chains(ranks: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and lag of every row of seeds that follow each other on one diagonal with low <= lag <= high."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    index = ranks[order].astype(np.int64) * (n + 1) + order
    seed = np.arange(0, n, width)
    base = ranks[seed].astype(np.int64) * (n + 1)
    left = np.searchsorted(index, base + np.minimum(seed + low, n))
    count = np.searchsorted(index, base + np.minimum(seed + high, n - 1), side="right") - left
    count = np.maximum(count, 0)
    first = np.repeat(seed, count)
    lag = order[np.arange(len(first)) + np.repeat(left - np.cumsum(count) + count, count)] - first
    by_lag = np.lexsort((first, lag))
    first, lag = first[by_lag], lag[by_lag]
    fresh = np.ones(len(first) + 1, dtype=bool)
    fresh[1:-1] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + width)
    begins, ends = np.flatnonzero(fresh[:-1]), np.flatnonzero(fresh[1:])
    return first[begins], first[ends] + width, lag[begins]


def find_runs(ranks: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in a row of word ranks; texts of up to ``longest`` words differ in all ranks."""
    width = max((-(-least // 2) + 1) // 2, 1)
    levels, grams = [(1, ranks)], ranks
    for k in range(1, width):
        grams = pair_ranks(grams[:-1], ranks[k:])
    low, found, single = 1, [], max(width - 1, 1)
    while low <= longest // 2 and len(grams) and int(grams.max()) + 1 < len(grams):
        first, end, lag = _chains(grams, width, low, 4 * width - 2)
        end = end + _agreeing(levels, single, end, end + lag, True)
        first = first - _agreeing(levels, single, first, first + lag, False)
        good = end - first >= np.maximum(least - lag, lag)
        found.append(np.stack([first, end - first + lag, lag])[:, good])
        if width > 1:
            levels.append((width, grams))
        low, grams, width = 4 * width - 1, pair_ranks(grams[:-width], grams[width:]), 2 * width
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    start, length, period = np.concatenate(found, axis=1)
    # A run is met at all multiples of its period too; the smallest is its own.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    own = np.ones(len(start), dtype=bool)
    own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[own], length[own], period[own]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words with one space between them, copied piece by piece."""
    sizes = ends - starts + 1
    upto = np.cumsum(sizes)
    parts, first = [], 0
    while first < len(starts):
        done = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, done + COPY_BYTES, side="right")), first + 1)
        at = np.repeat(starts[first:last] - (upto[first:last] - sizes[first:last]), sizes[first:last]) + np.arange(done, upto[last - 1])
        piece = data[np.minimum(at, len(data) - 1)]
        piece[upto[first:last] - 1 - done] = 32
        parts.append(piece.tobytes())
        first = last
    return b"".join(parts)[:-1]


def _collapse(chunk: Chunk, least: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each row."""
    starts, ends, row = words(chunk)
    counts = np.bincount(row, minlength=chunk.rows).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    start, length, period = find_runs(word_ranks(chunk, starts, ends, row), int(counts.max(initial=0)), least)
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    covered = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, start + length, -1)
    stays = np.cumsum(covered[:-1]) == 0
    of = row[start] if len(start) else start
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=chunk.rows))]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(start - begins[of]), pa.array(length), pa.array(period)], names=["start", "length", "period"]),
    )
    texts = []
    for i in range(chunk.rows):
        here = slice(begins[i], begins[i + 1])
        texts.append(_joined(chunk.data, starts[here][stays[here]], ends[here][stays[here]]))
    return counts, lists, pa.array(texts, pa.string())


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the number of words, all runs by start and period, and the words outside repeats joined by spaces."""
    own = [c for c in docs.columns if c.lower() not in ADDED]
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*own).alias("held"))
    schema = StructType(rows.select("held").schema.fields + StructType.fromDDL(MADE).fields)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                counts, lists, texts = _collapse(chunk, least)
                held = batch.column(1).slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays([held, pa.array(counts), lists, texts], names=["held", *ADDED])

    out = rows.mapInArrow(detect, schema)
    return out.select(*[F.col("held")[c].alias(c) for c in own], *ADDED)
