"""Exact set-similarity join of documents on distinct five-word shingles, with components of linked documents.

A document's shingles, as 64-bit hashes, are ordered by how frequent they are and then by hash.  Two sets whose Jaccard
similarity reaches the threshold share at least ``spare`` shingles within their first ``size - least overlap + spare``,
so only that prefix is indexed: one list of (document, set size, position) per shingle.

Skipping by set relations: entries of a list that agree in size and position form a block, and the bound on the overlap
of two blocks skips all their pairs at once.  Short lists give the pairs that remain, counted over all lists.  A long
list first gives one pair per entry, with a leading entry.  Pairs are verified on the whole texts, and the answers found
are carried over: a document that is highly similar to a leader has the leader's component, so what is left of a long
list are the documents outside its largest component.  Where that component is large, these are compared in blocks with
all documents of the same lists; elsewhere pairs are formed and must share as many shingles as the bound asks.

Frequency is estimated by mergeable counters (Misra-Gries) over all documents; it orders shingles only, and any order
gives the same result.  At most ``MOST_FREQUENT`` shingles are handed to tasks.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer words than a
shingle make one shingle of all of them; rows that share a ``doc_id`` are one node and keep a row each; a null
``doc_id`` is never linked and has a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.llm.components import components
from concourse.llm.kernels import Chunk, SubstringHash, chunks, mix, signed, words
from concourse.llm.tables import stored

WORDS = 5
THRESHOLD = Fraction(4, 5)
SHORT_LIST = 4
FREQUENT = 24
MOST_FREQUENT = 1 << 17
COUNTERS = 1 << 16
PART = 256
HEAVY = 32
SPLIT_GRADE = 12
_U64 = np.uint64
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
SETS = "doc_id long, n_shingles long, low long, high long"
ENTRIES = "shingle long, part int, doc_id long, size int, at int"
FOUND = "a long, b long, size_a int, size_b int, shared int, star boolean, shingle long, at int"
LINKS = "a long, b long"


def shingles(chunk: Chunk, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the texts' offsets into them."""
    starts, ends, row = words(chunk)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(chunk.rows + 1, np.int64)
    word = SubstringHash(chunk.data, lower=True).of(starts, ends)
    first = np.searchsorted(row, np.arange(chunk.rows + 1))
    count = np.diff(first)
    inside = row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.empty(0, bool)
    at = np.flatnonzero(inside)
    value = np.zeros(len(at), dtype=np.uint64)
    for i in range(n):
        value += word[at + i] * _STEPS[i % len(_STEPS)] * _U64(2 * (i // len(_STEPS)) + 1)
    value, owner = mix(value), row[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = [np.add.reduce(word[first[r] : first[r] + count[r]] * _STEPS[: count[r]]) + _U64(count[r]) for r in short]
        value = np.concatenate([value, mix(np.array(whole, dtype=np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(chunk.rows + 1)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        value[a:b].sort()
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(chunk.rows + 1))


def signatures(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        sums = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(mix(value ^ _U64(salt)), out=sums[1:])
        out.append(sums[offsets[1:]] - sums[offsets[:-1]])
    return out[0], out[1]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, set size and digests of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                value, offsets = shingles(chunk)
                low, high = signatures(value, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.rows), pa.array(np.diff(offsets)), pa.array(signed(low)), pa.array(signed(high))],
                    names=["doc_id", "n_shingles", "low", "high"],
                )

    return _rows(docs).mapInArrow(measure, SETS)


class _Counters:
    """Misra-Gries counters: counts of the most frequent values, too low by a bounded amount at most."""

    def __init__(self, most: int = COUNTERS):
        self.most, self.values, self.counts, self.fresh, self.n = most, np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.fresh.append(values)
        self.n += len(values)
        if self.n > 8 * self.most:
            self.fold()

    def fold(self) -> None:
        fresh, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *self.fresh]), return_counts=True)
        self.fresh, self.n = [], 0
        values = np.concatenate([self.values, fresh])
        weights = np.concatenate([self.counts, counts])
        self.values, at = np.unique(values, return_inverse=True)
        self.counts = np.bincount(at, weights=weights).astype(np.int64) if len(values) else weights.astype(np.int64)
        if len(self.values) > self.most:
            least = np.partition(self.counts, len(self.counts) - self.most - 1)[len(self.counts) - self.most - 1]
            keep = self.counts > least
            self.values, self.counts = self.values[keep], self.counts[keep] - least


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all documents, sorted, and the logarithm of how often each occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, known = _Counters(), set()
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                value, offsets = shingles(chunk)
                low, _ = signatures(value, offsets)
                for i, digest in enumerate(low.tolist()):
                    if digest not in known:  # copies within the task count once
                        if len(known) < COUNTERS:
                            known.add(digest)
                        counters.add(value[offsets[i] : offsets[i + 1]])
        counters.fold()
        twice = counters.counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(signed(counters.values[twice])), pa.array(counters.counts[twice])], names=["shingle", "n"])

    counts = _rows(docs).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).collect()
    values = np.array([r["shingle"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    grades = np.log2(np.array([r["n"] for r in top], dtype=np.float64) + 1).astype(np.int64) if top else np.empty(0, np.int64)
    return values[order], grades[order]


def spare(size):
    """How many shared shingles the index must show for a set of that size."""
    return 2 + size // 32


def prefix_length(size: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """How many leading shingles a set must show: size - ceil(threshold * size) + spare, at most all."""
    p, q = threshold.numerator, threshold.denominator
    return np.minimum(size, size - (size * p + q - 1) // q + spare(size))


def least_shared(size_a, size_b, threshold: Fraction = THRESHOLD):
    """The overlap two sets need: ceil(threshold / (1 + threshold) * (size_a + size_b))."""
    p, q = threshold.numerator, threshold.numerator + threshold.denominator
    return (p * (size_a + size_b) + q - 1) // q


def _ordered(value: np.ndarray, offsets: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Order of all shingles by text, then rarer first, then hash; they come sorted by hash."""
    order = np.arange(len(value))
    graded = np.flatnonzero(np.add.reduceat(grade, offsets[:-1][np.diff(offsets) > 0])) if len(value) else []
    texts = np.flatnonzero(np.diff(offsets) > 0)
    for i in texts[graded].tolist() if len(graded) else []:
        a, b = offsets[i], offsets[i + 1]
        order[a:b] = a + np.argsort(grade[a:b], kind="stable")
    return order


def index_entries(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The prefix of every set: shingle, doc_id, set size and position.

    The list of a very frequent shingle is dealt into parts by document, 1 and up; other lists are part 0.  Equal sets
    of one task are listed once: copies are joined by their digests.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT pairs

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, grades), seen = shared.value, set()
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                value, offsets = shingles(chunk)
                sizes = np.diff(offsets)
                low, high = signatures(value, offsets)
                fresh = np.ones(chunk.rows, dtype=bool)
                for i, digest in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    fresh[i] = digest not in seen
                    if fresh[i] and len(seen) < COUNTERS:
                        seen.add(digest)
                owner = np.repeat(np.arange(chunk.rows), sizes)
                grade = np.zeros(len(value), dtype=np.int64)
                if len(known) and len(value):
                    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    grade = np.where(known[at] == value, grades[at] + 1, 0)
                order = _ordered(value, offsets, grade)
                place = np.arange(len(value)) - offsets[owner]
                keep = np.flatnonzero((place < prefix_length(sizes)[owner]) & fresh[owner])
                value, grade = value[order[keep]], grade[order[keep]]
                parts = np.left_shift(1, np.maximum(grade - SPLIT_GRADE, 0)).astype(np.uint64)
                part = np.where(parts > 1, mix(value ^ low[owner[keep]]) % parts + _U64(1), _U64(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(value)),
                        pa.array(part.astype(np.int32)),
                        batch.column(0).take(pa.array(owner[keep] + chunk.first)),
                        pa.array(sizes[owner[keep]].astype(np.int32)),
                        pa.array(place[keep].astype(np.int32)),
                    ],
                    names=["shingle", "part", "doc_id", "size", "at"],
                )

    return _rows(docs.filter(F.col("doc_id").isNotNull())).mapInArrow(index, ENTRIES)


def _possible(size: int, at: int, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which entries may pair with one of ``size`` and ``at``: enough can be shared before, at and after these places."""
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    fits = q * np.minimum(size, sizes) >= p * np.maximum(size, sizes)
    return fits & (np.minimum(at, places) + 1 + np.minimum(size - 1 - at, sizes - 1 - places) >= least_shared(size, sizes))


def _blocks(sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by (size, position), and where each block of equal ones starts (one more at the end)."""
    order = np.lexsort((places, sizes))
    s, p = sizes[order], places[order]
    fresh = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (p[1:] != p[:-1]))) if len(s) else np.empty(0, np.int64)
    return order, np.append(fresh, len(s))


def list_pairs(doc: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
    """All possible pairs of one list with their sizes, whole blocks skipped at a time."""
    order, starts = _blocks(sizes, places)
    head = order[starts[:-1]]
    doc, size = doc[order].tolist(), sizes[order].tolist()
    out = []
    for i in range(len(head)):
        ok = np.flatnonzero(_possible(int(sizes[head[i]]), int(places[head[i]]), sizes[head[i:]], places[head[i:]])) + i
        for j in ok.tolist():
            for x in range(starts[i], starts[i + 1]):
                out += [(doc[x], doc[y], size[x], size[y]) for y in range(max(x + 1, starts[j]), starts[j + 1])]
    return out


def star_pairs(doc: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
    """One possible pair per entry of a long list: with the first leading entry whose block allows it."""
    order = np.lexsort((doc, sizes))
    doc, sizes, places = doc[order], sizes[order], places[order]
    left, out = np.arange(len(doc)), []
    while len(left):
        lead, rest = left[0], left[1:]
        ok = _possible(int(sizes[lead]), int(places[lead]), sizes[rest], places[rest])
        out += [(int(doc[lead]), x, int(sizes[lead]), y) for x, y in zip(doc[rest[ok]].tolist(), sizes[rest[ok]].tolist(), strict=True)]
        left = rest[~ok]
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each list, in a stream sorted by (shingle, part); a list may span batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        fresh = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = [c[a:b] for c in columns]
            if held and (held[0][0][0], held[0][1][0]) != (part[0][0], part[1][0]):
                yield held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _found(pairs: dict[tuple, int], lists: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Pairs, then entries of long lists (their ``b`` is null)."""
    n = len(pairs)
    a, b, size_a, size_b, star = (list(c) for c in zip(*pairs, strict=True)) if n else ([],) * 5
    shingle, doc, size, at = (np.concatenate([x[i] for x in lists]) if lists else np.empty(0, np.int64) for i in (0, 2, 3, 4))
    m = len(doc)

    def column(first: list, then, kind: pa.DataType) -> pa.Array:
        then = pa.nulls(m, kind) if then is None else pa.array(then).cast(kind)
        return pa.concat_arrays([pa.array(first, kind), then])

    none = [None] * n
    return pa.RecordBatch.from_arrays(
        [
            column(a, doc, pa.int64()),
            column(b, None, pa.int64()),
            column(size_a, size, pa.int32()),
            column(size_b, None, pa.int32()),
            column(list(pairs.values()), None, pa.int32()),
            column(star, None, pa.bool_()),
            column(none, shingle, pa.int64()),
            column(none, at, pa.int32()),
        ],
        names=["a", "b", "size_a", "size_b", "shared", "star", "shingle", "at"],
    )


def _read_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted pairs of all lists, and the entries of the long ones."""
    pairs: dict[tuple, int] = {}
    kept, size = [], 0
    for run in _lists(batches):
        if len(run[0]) > 1 or run[1][0]:
            long = bool(len(run[0]) > SHORT_LIST or run[1][0])
            for a, b, size_a, size_b in (star_pairs if long else list_pairs)(run[2], run[3], run[4]):
                if a != b:
                    key = (a, b, size_a, size_b, long) if a < b else (b, a, size_b, size_a, long)
                    pairs[key] = pairs.get(key, 0) + 1
            if long:
                kept.append(run)
                size += len(run[0])
        if len(pairs) > 200_000 or size > 200_000:
            yield _found(pairs, kept)
            pairs, kept, size = {}, [], 0
    yield _found(pairs, kept)


class Heads:
    """Sets that wait for others to be compared with: an index of all their shingles."""

    def __init__(self):
        self.docs, self.labels, self.sets, self.ready = [], [], [], False
        self.joined: dict[int, int] = {}

    def _root(self, label: int) -> int:
        while (up := self.joined.get(label, label)) != label:
            self.joined[label] = self.joined.get(up, up)
            label = up
        return label

    def add(self, doc: int, label: int, shingle: np.ndarray) -> None:
        self.docs.append(doc)
        self.labels.append(label)
        self.sets.append(shingle.copy())
        self.ready = False

    def linked(self, doc: int, label: int, shingle: np.ndarray) -> list[int]:
        """One linked document of each component that this group has not yet joined with the document's own."""
        if not self.ready:
            sizes = np.array([len(x) for x in self.sets], dtype=np.int64)
            value, owner = np.concatenate(self.sets), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(value, kind="stable")
            self.sizes, self.value, self.owner, self.ready = sizes, value[order], owner[order], True
        first, last = np.searchsorted(self.value, shingle), np.searchsorted(self.value, shingle, side="right")
        count = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        shared = np.bincount(self.owner[at], minlength=len(self.docs))
        p, q = THRESHOLD.numerator, THRESHOLD.denominator
        out = []
        for i in np.flatnonzero((shared > 0) & (q * shared >= p * (self.sizes + len(shingle) - shared))).tolist():
            mine, other = self._root(label), self._root(self.labels[i])
            if mine != other:
                self.joined[max(mine, other)] = min(mine, other)
                out.append(self.docs[i])
        return out


def linked_pairs(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """Verified links (a, b), on the whole texts, between the heads and the members of each group.

    ``needs``: doc, group, part, turn (0 for heads, 1 for members) and label; documents of equal label are not compared.
    """
    # The same plan at every size: both sides are shuffled, whatever this side's size is.
    held = _rows(docs).hint("merge").join(needs, F.col("doc_id") == F.col("doc")).select("group", "part", "turn", "doc_id", "label", "text")
    held = held.repartition("group", "part").sortWithinPartitions("group", "part", "turn")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, Heads()
        for batch in batches:
            for chunk in chunks(batch.column(5)):
                value, offsets = shingles(chunk)
                rows = batch.slice(chunk.first, chunk.rows)
                group, part, turn, doc, label = (rows.column(i).to_pylist() for i in range(5))
                out = []
                for i in range(chunk.rows):
                    own = value[offsets[i] : offsets[i + 1]]
                    if (group[i], part[i]) != now:
                        now, heads = (group[i], part[i]), Heads()
                    if turn[i] == 0:
                        heads.add(doc[i], label[i], own)
                    elif len(own) and heads.docs:
                        out += [(min(doc[i], h), max(doc[i], h)) for h in heads.linked(doc[i], label[i], own)]
                columns = list(zip(*out, strict=True)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["a", "b"])

    return held.mapInArrow(compare, LINKS).distinct()


def pair_needs(pairs: DataFrame) -> DataFrame:
    """Groups for pairs (a, b): one end is the head, the one with more pairs; its members come in parts."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    degree = stored(ends.groupBy("node").agg(F.count("*").alias("n")), "degrees")
    by_a, by_b = degree.withColumnsRenamed({"node": "a", "n": "na"}), degree.withColumnsRenamed({"node": "b", "n": "nb"})
    lead = F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b"))
    placed = pairs.join(by_a, "a").join(by_b, "b").select(
        lead.alias("group"),
        F.when(lead == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("doc"),
        F.ceil(F.greatest("na", "nb") / PART).cast("int").alias("parts"),
    )
    placed = stored(placed.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")), "pairs")
    members = placed.select("doc", "group", "part", F.lit(1).alias("turn"), F.col("doc").alias("label"))
    heads = placed.select("group", "part").distinct()
    return members.union(heads.select(F.col("group").alias("doc"), "group", "part", F.lit(0), F.col("group").alias("label")))


def _needed() -> Column:
    """How many shared shingles the index shows of a pair that links."""
    p, q = THRESHOLD.numerator, THRESHOLD.numerator + THRESHOLD.denominator
    least = F.ceil(p * (F.col("size_a") + F.col("size_b")) / q)
    return F.least(2 + F.floor(F.col("size_a") / 32), 2 + F.floor(F.col("size_b") / 32), least)


def _labelled(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    to = labels.withColumnsRenamed({"node": "_node", "label": "_of"})
    return df.join(to, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_of", column)).drop("_node", "_of")


def remaining(entries: DataFrame, pairs: DataFrame, done: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What could still join two components: pairs to verify, and groups (``needs``) around large components."""
    rows = stored(_labelled(entries, "doc", labels, "label"), "entries")
    sizes = rows.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("k")).filter(F.col("k") > 1)
    rows = rows.join(lists.select("shingle", F.col("main.label").alias("main"), F.col("main.n").alias("n_main")), "shingle")
    heavy = rows.filter(F.col("n_main") >= HEAVY).select("main", "doc", "label").distinct()
    light = rows.filter(F.col("n_main") < HEAVY)
    other = light.select("shingle", *[F.col(c).alias("_" + c) for c in ("doc", "size", "at", "label")])
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    room = F.least("at", "_at") + 1 + F.least(F.col("size") - 1 - F.col("at"), F.col("_size") - 1 - F.col("_at"))
    open_pairs = light.join(other, "shingle").filter(
        (F.col("doc") < F.col("_doc"))
        & (F.col("label") != F.col("_label"))
        & (q * F.least("size", "_size") >= p * F.greatest("size", "_size"))
        & (room >= F.ceil(p * (F.col("size") + F.col("_size")) / (p + q)))
    )
    open_pairs = open_pairs.select(F.col("doc").alias("a"), F.col("_doc").alias("b"), F.col("size").alias("size_a"), F.col("_size").alias("size_b"), F.lit(1).alias("shared"))
    short = _labelled(_labelled(pairs, "a", labels, "la"), "b", labels, "lb").filter(F.col("la") != F.col("lb")).drop("la", "lb")
    counted = open_pairs.unionByName(short).groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    counted = counted.filter(F.col("shared") >= _needed()).select("a", "b").distinct()
    heads = heavy.filter(F.col("label") != F.col("main"))
    parts = heads.groupBy("main").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    heavy = heavy.join(parts, "main")
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    columns = ["doc", F.col("main").alias("group"), "part", "turn", "label"]
    needs = heavy.filter(F.col("label") != F.col("main")).withColumns({"part": part, "turn": F.lit(0)}).select(*columns)
    members = heavy.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("turn", F.lit(1)).select(*columns)
    return counted.join(done, ["a", "b"], "left_anti"), needs.union(members)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sets = stored(document_sets(docs), "sets")
    classes = sets.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    keepers = classes.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
    copies = classes.join(keepers.filter(F.col("n") > 1).drop("n"), ["low", "high", "n_shingles"])
    copies = stored(copies.filter(F.col("doc_id") != F.col("keeper")).select(F.col("doc_id").alias("copy"), "keeper").distinct(), "copies")
    # Of copies, one stands for all; a doc_id that stands for two different sets is not replaced.
    single = copies.join(sets.groupBy(F.col("doc_id").alias("copy")).agg(F.count("*").alias("n")).filter(F.col("n") == 1).drop("n"), "copy")
    single = stored(single, "copies")

    def kept(df: DataFrame, *columns: str) -> DataFrame:
        for column in columns:
            to = single.withColumnsRenamed({"copy": "_copy", "keeper": "_keeper"})
            df = df.join(to, F.col(column) == F.col("_copy"), "left").withColumn(column, F.coalesce("_keeper", column)).drop("_copy", "_keeper")
        return df

    entries = index_entries(docs, frequent_shingles(docs))
    entries = entries.repartition("shingle", "part").sortWithinPartitions("shingle", "part")
    found = stored(entries.mapInArrow(_read_lists, FOUND), "lists")
    pairs = found.filter(F.col("b").isNotNull()).groupBy("a", "b", "size_a", "size_b", "star").agg(F.sum("shared").alias("shared"))
    pairs = kept(pairs, "a", "b").filter(F.col("a") != F.col("b"))
    swap = F.col("a") > F.col("b")
    pairs = pairs.select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
        F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"),
        "shared",
        "star",
    )
    pairs = stored(pairs.groupBy("a", "b", "size_a", "size_b", "star").agg(F.sum("shared").alias("shared")), "counted")
    first = stored(pairs.filter(F.col("shared") >= F.when(F.col("star"), F.lit(2)).otherwise(_needed())).select("a", "b").distinct(), "pairs")
    same = copies.select(F.col("copy").alias("a"), F.col("keeper").alias("b"))
    links = stored(linked_pairs(docs, pair_needs(first)), "links").union(same)
    labels = components(links)
    long = kept(found.filter(F.col("b").isNull()).select("shingle", F.col("a").alias("doc"), F.col("size_a").alias("size"), "at"), "doc").distinct()
    open_pairs, needs = remaining(long, pairs.filter(~F.col("star")).drop("star"), first, labels)
    open_pairs, needs = stored(open_pairs, "open-pairs"), stored(needs, "open-groups")
    groups = []
    if open_pairs.limit(1).count():
        groups.append(pair_needs(open_pairs))
    if needs.limit(1).count():
        groups.append(needs)
    if groups:
        # Group numbers of the two kinds must not meet.
        marked = [g.withColumn("part", 2 * F.col("part") + i) for i, g in enumerate(groups)]
        more = stored(linked_pairs(docs, marked[0] if len(marked) == 1 else marked[0].unionByName(marked[1])), "links")
        if more.limit(1).count():
            labels = components(links.union(more))
    labels = labels.withColumnsRenamed({"node": "_node", "label": "_label"})
    out = sets.join(labels, F.col("doc_id") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_label", "doc_id").alias("component_id"))
