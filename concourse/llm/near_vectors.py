"""Near-duplicate vectors within a label, by tiled comparison along principal axes.

Vectors are scaled to length one and turned to the principal axes of the table, so that the leading coordinates hold most
of what tells vectors apart.  Equal vectors of a label stand together as one class with a weight.  Classes lie in tiles:
ranges of the interleaved leading coordinates (equal ranges, so a hot label has many tiles) of at most ``TILE_BYTES``,
with the box of their leading coordinates.  Two tiles of a label meet unless their boxes are further apart than any two
vectors of the threshold can be.  Inside a pair of tiles products are summed over the leading coordinates first; what the
others can add is at most the product of the two suffix norms, and a pair is left as soon as sum and bound stay below the
threshold.  Pairs that remain are decided by the cosine of the vectors as they came, in double precision.

A pair of tiles gives the number of links per class and a spanning forest of its links, never the links themselves, so a
group of thousands of near copies gives as many rows as it has members.  Axes only order the work: any orthonormal basis
gives the same links.  Two tiles and a square of products are what a task holds.

Defined cases: a vector that is null, empty, all zero or that holds a null or a number that is not finite links with
nothing, and so does one without a label; vectors of different lengths do not link; rows with equal vectors and label are
linked with each other, also under one ``vec_id``; a null ``vec_id`` counts as a vector but gives no component its name; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.llm.components import components
from concourse.llm.tables import stored

THRESHOLD = 0.93
TILE_BYTES = 4 << 20
LEADING = 8  # coordinates of a tile's box
STEPS = (12, 24)  # leading coordinates summed before each bound is tried
SQUARE = 1024  # vectors on each side of the products held at once
SLACK = 1e-9  # of a bound, for rounding
SLOTS = 32  # rows that the sums of products meet in before the driver adds them


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (doubles) of the vectors that can link."""
    e = F.col("embedding").cast("array<double>")
    real = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "label", e.alias("vector"))
    return rows.filter(F.col("label").isNotNull() & F.coalesce(real & F.exists(e, lambda x: x != 0), F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest part first, so that no square leaves the range of doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(rows: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of all usable vectors with ``dims`` parts: sums of products by partition, then by slot, then on the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for first in range(0, batch.num_rows, SQUARE):
                u = unit(matrix(batch.column(0).slice(first, SQUARE)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims * dims)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.filter(F.size("vector") == dims).select("vector").mapInArrow(sums, "sums binary")
    found = parts.repartition(SLOTS).mapInArrow(added, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"]) for r in found), np.zeros(dims * dims)).reshape(dims, dims)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


TILES = "label string, dims int, tile string, low array<double>, high array<double>, keys binary, weights binary, vectors binary"


def _curve(turned: np.ndarray) -> np.ndarray:
    """Interleaved bits of the three leading coordinates, 10 bits each."""
    place = np.zeros(len(turned), dtype=np.int64)
    cells = np.clip(((turned[:, :3] + 1) * 512).astype(np.int64), 0, 1023)
    for bit in range(9, -1, -1):
        for axis in range(cells.shape[1]):
            place = place << 1 | (cells[:, axis] >> bit & 1)
    return place


def placed(classes: DataFrame, axes: np.ndarray) -> DataFrame:
    """``classes`` with the place of each vector on a curve through the leading coordinates."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.zeros(batch.num_rows, dtype=np.int64)
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                where[at] = _curve(turn(unit(matrix(batch.column(2).take(pa.array(at)))), axes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where)], names=[*batch.schema.names, "place"])

    return classes.select("label", "dims", "vector", "class", "weight").mapInArrow(
        place, "label string, dims int, vector array<double>, class long, weight long, place long"
    )


def turn(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Vectors along the axes; those of another length keep theirs."""
    return units @ axes if units.shape[1] == len(axes) else units


def tiled(classes: DataFrame, axes: np.ndarray, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row per tile: its label, the box of its leading coordinates, its classes and their vectors."""
    order = ["label", "dims", "place"]
    ranged = placed(classes, axes).repartitionByRange(*order).sortWithinPartitions(*order)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tile(label: str, dims: int, rows: pa.Table) -> pa.RecordBatch:
            vectors = matrix(rows.column("vector").combine_chunks())
            turned = turn(unit(vectors), axes)[:, :LEADING]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            keys, weights = (rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("class", "weight"))
            values = [label, dims, uuid.uuid4().hex, turned.min(axis=0).tolist(), turned.max(axis=0).tolist(), keys, weights, vectors.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in TILES.split(", ")])

        def whole(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            """Full tiles of a sorted table, and the rows that wait for more."""
            out = []
            while rows.num_rows:
                label, dims = rows.column("label")[0].as_py(), rows.column("dims")[0].as_py()
                same = (np.asarray(rows.column("label").to_numpy() == label)) & (rows.column("dims").to_numpy() == dims)
                n = int(np.argmin(same)) if not same.all() else rows.num_rows
                most = max(tile_bytes // (8 * dims), 1)
                if n == rows.num_rows and n < most and not last:
                    break
                out.append(tile(label, dims, rows.slice(0, min(n, most))))
                rows = rows.slice(min(n, most))
            return out, rows

        waiting: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            waiting = part if waiting is None or not waiting.num_rows else pa.concat_tables([waiting, part])
            done, waiting = whole(waiting, False)
            yield from done
        if waiting is not None and waiting.num_rows:
            yield from whole(waiting, True)[0]

    return ranged.mapInArrow(gather, TILES)


def _apart(t: float) -> Column:
    """The boxes of two tiles lie further apart than two unit vectors of cosine ``t`` can."""
    gaps = F.zip_with(
        F.zip_with("low", "o_high", lambda a, b: a - b), F.zip_with("o_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) > 2 - 2 * t + SLACK


class _Tile:
    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str, axes: np.ndarray):
        dims = batch.column("dims")[i].as_py()
        read = lambda name, kind: np.frombuffer(batch.column(prefix + name)[i].as_buffer(), kind)
        self.keys, self.weights = read("keys", np.int64), read("weights", np.int64)
        self.units = unit(read("vectors", np.float64).reshape(-1, dims))
        self.turned = turn(self.units, axes)
        squares = np.cumsum((self.turned * self.turned)[:, ::-1], axis=1)[:, ::-1]
        self.steps = [s for s in STEPS if s < dims]
        # What the coordinates from each step on can still add, at the most.
        self.rest = [np.sqrt(squares[:, s]) for s in self.steps]


def linked_pairs(a: _Tile, b: _Tile, t: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and in b of all pairs with a cosine of ``t`` or more, square by square."""
    for i in range(0, len(a.keys), SQUARE):
        for j in range(i if same else 0, len(b.keys), SQUARE):
            ia, jb = slice(i, i + SQUARE), slice(j, j + SQUARE)
            done, x, y = 0, None, None
            for k, step in enumerate(a.steps):
                if x is None:
                    sums = a.turned[ia, done:step] @ b.turned[jb, done:step].T
                    near = sums + np.outer(a.rest[k][ia], b.rest[k][jb]) >= t - SLACK
                    x, y = np.nonzero(near)
                    if 8 * len(x) > near.size:  # most of them are near: whole products are cheaper
                        x = None
                        break
                    sums = sums[x, y]
                else:
                    sums = sums + np.einsum("ij,ij->i", a.turned[x + i, done:step], b.turned[y + j, done:step])
                    near = sums + a.rest[k][x + i] * b.rest[k][y + j] >= t - SLACK
                    x, y, sums = x[near], y[near], sums[near]
                done = step
            if x is None:
                x, y = np.nonzero(a.units[ia] @ b.units[jb].T >= t)
            elif len(x):
                good = np.einsum("ij,ij->i", a.units[x + i], b.units[y + j]) >= t
                x, y = x[good], y[good]
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x + i, y + j


class _Forest:
    """Least members of the groups that links have joined so far; grows by arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            self.flatten()
            rx, ry = self.up[x], self.up[y]
            if (rx == ry).all():
                return
            np.minimum.at(self.up, np.maximum(rx, ry), np.minimum(rx, ry))

    def flatten(self) -> None:
        while True:
            further = self.up[self.up]
            if (further == self.up).all():
                return
            self.up = further


def compared(pairs: DataFrame, axes: np.ndarray, t: float) -> DataFrame:
    """Per pair of tiles: ``a`` with the weight ``n`` of what it links with, and links a - b that join all that is linked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("same")[i].as_py()
                a = _Tile(batch, i, "", axes)
                b = a if same else _Tile(batch, i, "o_", axes)
                keys, weights = (np.concatenate([p, q]) if not same else p for p, q in ((a.keys, b.keys), (a.weights, b.weights)))
                shift = 0 if same else len(a.keys)
                links, forest = np.zeros(len(keys), dtype=np.int64), _Forest(len(keys))
                for x, y in linked_pairs(a, b, t, same):
                    y = y + shift
                    np.add.at(links, x, weights[y])
                    np.add.at(links, y, weights[x])
                    forest.add(x, y)
                forest.flatten()
                met, joined = np.flatnonzero(links), np.flatnonzero(forest.up != np.arange(len(keys)))
                first = np.concatenate([keys[met], keys[joined]])
                other = pa.concat_arrays([pa.nulls(len(met), pa.int64()), pa.array(keys[forest.up[joined]])])
                count = np.concatenate([links[met], np.zeros(len(joined), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(first), other, pa.array(count)], names=["a", "b", "n"])

    return pairs.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    label = F.col("label").cast("string")
    classes = usable(vectors).groupBy(label.alias("label"), "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    # The numbers of the classes hold once they are written.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "*", F.size("vector").alias("dims")), "vector-classes")
    common = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    axes = principal_axes(classes, common[0]["dims"]) if common else np.eye(1)
    tiles = stored(tiled(classes, axes, tile_bytes), "vector-tiles")
    boxes = tiles.select("label", "dims", "tile", "low", "high")
    others = boxes.select("label", "dims", *[F.col(c).alias(f"o_{c}") for c in ("tile", "low", "high")])
    met = boxes.join(others, ["label", "dims"]).filter((F.col("tile") <= F.col("o_tile")) & ~_apart(threshold))
    met = met.select("tile", "o_tile", (F.col("tile") == F.col("o_tile")).alias("same"))
    held = tiles.select("tile", "dims", "keys", "weights", "vectors")
    other = tiles.select(*[F.col(c).alias(f"o_{c}") for c in ("tile", "keys", "weights", "vectors")])
    pairs = met.join(held, "tile").join(other, "o_tile").select("dims", "same", "keys", "weights", "vectors", "o_keys", "o_weights", "o_vectors")
    found = stored(compared(pairs, axes, threshold), "vector-links")
    links = found.groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "class")
    groups = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("label", "group")
    grouped = classes.join(groups, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("group", "class"))
    least = grouped.groupBy("group").agg(F.min("first").alias("component"))
    known = grouped.join(least, "group").join(links, "class", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n"), "component"
    )
    every = vectors.select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    out = every.join(known, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
