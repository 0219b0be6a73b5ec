"""Benchmark items found in documents, edits allowed.

An item of m characters may differ in ``m // LENGTH_PER_EDIT`` edits; cut into one piece more than that, at least one
piece stands in the text unchanged.  A task looks for all pieces of a block of items at once (Aho-Corasick), joins the
windows around the hits of one item, and verifies them with Myers' bit-parallel edit distance.  Items come to tasks in
blocks of at most ``BLOCK_CHARS`` characters; each further block is one more pass over the documents.

Texts and items are lower-cased and their white space becomes single spaces.  Defined cases: a null or empty text
matches nothing, an item without text is never found, equal items are all reported, repeated documents are reported
once each, a null ``doc_id`` stays null, an empty benchmark finds nothing; other columns are ignored by ``matches``
and pass through ``without_matches``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH_PER_EDIT = 20
BLOCK_CHARS = 4_000_000
HITS = "doc_id long, item_id long, distance int, end long"
_BUILT: dict[str, "Matcher"] = {}


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """One item, ready for Myers' bit-parallel search."""

    def __init__(self, item_id: int, text: str):
        self.item_id, self.text, self.budget = item_id, text, len(text) // LENGTH_PER_EDIT
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """Least edit distance to any substring of ``text`` and the first end of such a one."""
        m, masks = len(self.text), self.masks
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best = full, 0, m, (m, 0)
        for end, c in enumerate(text, 1):
            match = masks.get(c, 0)
            vertical = match | minus
            horizontal = (((match & plus) + plus) ^ plus) | match
            up = minus | ~(horizontal | plus) & full
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            if score < best[0]:
                best = (score, end)
            up = up << 1 & full
            plus = (down << 1 | ~(vertical | up)) & full
            minus = up & vertical
        return best


class Matcher:
    """All pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.patterns = [Pattern(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for at, pattern in enumerate(self.patterns):
            for offset, piece in pieces(pattern.text, pattern.budget):
                found.setdefault(piece, []).append((at, offset + len(piece)))
        for piece, uses in found.items():
            self.automaton.add_word(piece, uses)
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of the items that ``text`` holds within their budgets."""
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        if not self.patterns:
            return []
        for last, uses in self.automaton.iter(text):
            for at, offset in uses:
                pattern = self.patterns[at]
                start = last + 1 - offset - pattern.budget
                end = start + len(pattern.text) + 2 * pattern.budget
                spans = windows.setdefault(at, [])
                # Hits come by their ends, so starts of one item's windows can fall back by less than its length.
                while spans and start <= spans[-1][1]:
                    start, end = min(start, spans[-1][0]), max(end, spans.pop()[1])
                spans.append([start, end])
        out = []
        for at, spans in windows.items():
            pattern, best = self.patterns[at], None
            for start, end in spans:
                start = max(start, 0)
                distance, stop = pattern.search(text[start:end])
                if distance <= pattern.budget and (best is None or distance < best[0]):
                    best = (distance, start + stop)
            if best:
                out.append((pattern.item_id, *best))
        return out


def _matcher(key: str, items: list[tuple[int, str]]) -> Matcher:
    """The matcher of this Python worker for one block; an older block makes room."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items)
    return _BUILT[key]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance and end (in the normal form) of every item that a document holds."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in blocks(benchmark):
        shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared.value)
            for batch in batches:
                hits = [
                    (doc_id, *hit)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for hit in matcher.find(text.as_py())
                ]
                columns = list(zip(*hits, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "end"]
                )

        found = rows.mapInArrow(search, HITS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def without_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared.value)
            for batch in batches:
                keep = pa.array([not matcher.find(text.as_py()) for text in batch.column(at)], pa.bool_())
                yield batch.filter(keep) if pc.all(keep).as_py() is False else batch

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
