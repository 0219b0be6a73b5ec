"""Array kernels that run inside tasks: texts of an Arrow batch as bytes, words, lines and substring hashes.

A chunk is a run of whole texts, laid out as one byte array with row offsets.  Chunks hold about ``CHUNK_BYTES``
bytes, so that the arrays of a kernel stay small whatever the size of an Arrow batch; only a longer single text
makes a longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
WORD_BREAK = np.zeros(256, dtype=bool)
WORD_BREAK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_U64 = np.uint64


def _odd() -> int:
    return int(_RANDOM.integers(1 << 62, 1 << 63, dtype=np.uint64)) * 8 + 3 & (1 << 64) - 1


class _Family:
    """One substring hash: a random value per byte and a random odd base, modulo 2^64."""

    def __init__(self):
        self.table = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.lower = self.table[LOWER]
        self.base = _odd()
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, base & (1 << 64) - 1, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


FAMILIES = (_Family(), _Family())


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


class SubstringHash:
    """64-bit hashes of any substrings of a byte array, equal for equal bytes wherever they lie."""

    def __init__(self, data: np.ndarray, family: int = 0, lower: bool = False):
        self.family = FAMILIES[family]
        self.family.powers(len(data) + 1)
        values = (self.family.lower if lower else self.family.table)[data]
        values *= self.family.up[: len(data)]
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.family.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _U64(0x9E3779B97F4A7C15))


class Chunk:
    """Rows ``first .. first + len(offsets) - 2`` of a batch; null texts count as empty."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string or binary column, and their row offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts in runs of about ``limit`` bytes."""
    data, offsets = flat_texts(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a row border."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words ``[^\\x20\\x09-\\x0D]+``."""
    starts, ends = _runs(~WORD_BREAK[chunk.data], chunk.offsets)
    return starts, ends, row_of(starts, chunk.offsets)


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (without the line feed) and rows of all lines split at line feeds; an empty text has one empty line."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([chunk.offsets[1:], breaks]), kind="stable")
    at = np.cumsum(lines_per_row(breaks, chunk.offsets))
    rows = np.repeat(np.arange(chunk.rows), np.diff(np.concatenate([[0], at])))
    return starts, ends, rows


def lines_per_row(breaks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(breaks, offsets)) + 1


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def per_row(rows: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    """Whole-number sums per row."""
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    return np.bincount(rows, weights=weights, minlength=n).round().astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte position (one longer than ``data``)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)
