"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, the whole text.  Each passage is encoded from its hashed byte
trigrams; gated attention, learned from document labels alone, weighs the passages, and the score is a logistic
function of the weighted sum of their codes.  Training takes a sample of labelled rows that is bounded by ``MOST_ROWS``
rows and ``MOST_BYTES`` of text (chosen by hash of the id) on the driver; scoring runs over all documents in tasks.

Defined cases: a null or empty text is one empty passage; labelled rows without a document or without a label are
left out; a document labelled twice counts twice; repeated rows get equal scores; a null ``doc_id`` is not held out;
without any labelled row every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from concourse.llm.kernels import Chunk, chunks

PASSAGE = 512
FEATURES = 512
CODE = 32
GATE = 16
MOST_ROWS = 4000
MOST_BYTES = 12_000_000
EPOCHS = 15
BATCH = 32
RATE = 0.01
SCORES = "doc_id long, held_out boolean, score double"


def passages(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Square-root trigram shares of every passage of a chunk, and the first passage of each text (one entry more)."""
    sizes = np.diff(chunk.offsets)
    first = np.zeros(chunk.rows + 1, dtype=np.int64)
    np.cumsum(np.maximum(-(-sizes // PASSAGE), 1), out=first[1:])
    n = int(first[-1])
    data = chunk.data.astype(np.uint32)
    if len(data) < 3:
        return np.zeros((n, FEATURES), dtype=np.float32), first
    bucket = (data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(23)
    row = np.repeat(np.arange(chunk.rows), sizes)
    inside = np.flatnonzero(row[:-2] == row[2:])
    row = row[inside]
    passage = first[row] + (inside - chunk.offsets[row]) // PASSAGE
    counts = np.bincount(passage * FEATURES + bucket[inside], minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)), first


@dataclass
class Model:
    """Encoder, gated attention and the logistic head."""

    encode: np.ndarray
    shift: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    head: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(seed: int = 7) -> "Model":
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        zero = lambda n: np.zeros(n, dtype=np.float32)
        return Model(draw(FEATURES, CODE) * 3, zero(CODE), draw(CODE, GATE), draw(CODE, GATE), draw(GATE), zero(CODE), zero(1))

    def parts(self) -> list[np.ndarray]:
        return [self.encode, self.shift, self.tanh, self.gate, self.weigh, self.head, self.bias]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Codes, attention (summing to one in each bag) and the score of bags ``first[i] .. first[i + 1]``."""
        code = np.tanh(x @ self.encode + self.shift)
        left, right = np.tanh(code @ self.tanh), 1 / (1 + np.exp(-(code @ self.gate)))
        logit = (left * right) @ self.weigh
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        power = np.exp(logit - np.maximum.reduceat(logit, first[:-1])[bag])
        share = power / np.add.reduceat(power, first[:-1])[bag]
        pooled = np.add.reduceat(code * share[:, None], first[:-1])
        score = 1 / (1 + np.exp(-np.clip(pooled @ self.head + self.bias, -30, 30)))
        return {"code": code, "left": left, "right": right, "bag": bag, "share": share, "pooled": pooled, "score": score}

    def slopes(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean log loss, in the order of ``parts``."""
        f = self.forward(x, first)
        error = (f["score"] - y) / len(y)
        d_pooled = error[:, None] * self.head
        d_share = (f["code"] * d_pooled[f["bag"]]).sum(axis=1)
        mean = np.add.reduceat(d_share * f["share"], first[:-1])
        d_logit = f["share"] * (d_share - mean[f["bag"]])
        both = f["left"] * f["right"]
        d_both = d_logit[:, None] * self.weigh
        d_left = d_both * f["right"] * (1 - f["left"] ** 2)
        d_right = d_both * f["left"] * f["right"] * (1 - f["right"])
        d_code = f["share"][:, None] * d_pooled[f["bag"]] + d_left @ self.tanh.T + d_right @ self.gate.T
        d_raw = d_code * (1 - f["code"] ** 2)
        return [
            x.T @ d_raw,
            d_raw.sum(axis=0),
            f["code"].T @ d_left,
            f["code"].T @ d_right,
            both.T @ d_logit,
            f["pooled"].T @ error,
            np.array([error.sum()]),
        ]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam over shuffled batches of bags; the same sample gives the same model."""
    model, r = Model.start(), np.random.default_rng(11)
    parts = model.parts()
    means, squares, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs if len(bags) else 0):
        order = r.permutation(len(bags))
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            x = np.concatenate([bags[j] for j in pick]).astype(np.float32)
            first = np.cumsum([0, *(len(bags[j]) for j in pick)])
            t += 1
            for p, g, m, v in zip(parts, model.slopes(x, first, labels[pick]), means, squares, strict=True):
                g = g + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def place(row: Row) -> tuple[int, int, int, int]:
    """Order of the training rows; no place in the table plays a part."""
    return (row["doc_id"] * 2654435761) % (1 << 32), row["doc_id"], row["quality"], row["version"] or 0


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the training rows: at most ``most_rows`` rows and ``MOST_BYTES`` of text.

    The rows are chosen by their sizes alone; features are made and sent only for those.  A text above the bound is no
    training row.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "quality").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("version"), "text")
    sizes = rows.select("doc_id", "quality", "version", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    # Ids that stand for several texts may give more rows than were chosen.
    known = sizes.orderBy(F.xxhash64("doc_id"), "quality", "version").limit(most_rows).collect()
    taken, size = [], 0
    for row in sorted(known, key=place):
        if row["size"] <= MOST_BYTES:
            size += row["size"]
            if size > MOST_BYTES:
                break
            taken.append((row["doc_id"], row["quality"], row["version"]))
    if not taken:
        return [], np.empty(0, dtype=np.float32)
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, quality int, version long").distinct()
    rows = rows.join(F.broadcast(wanted), ["doc_id", "quality", "version"]).select("doc_id", "quality", "text", "version")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                x, first = passages(chunk)
                x = x.astype(np.float16)
                part = batch.slice(chunk.first, chunk.rows)
                bags = [x[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(bags, pa.binary())],
                    names=["doc_id", "quality", "version", "bag"],
                )

    # Equal texts under one id are one training row.
    coded = rows.dropDuplicates(["doc_id", "quality", "version"]).mapInArrow(encode, "doc_id long, quality int, version long, bag binary")
    found = sorted(coded.collect(), key=place)
    bags = [np.frombuffer(row["bag"], np.float16).reshape(-1, FEATURES) for row in found]
    return bags, np.array([row["quality"] for row in found], dtype=np.float32)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted label of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                part = batch.slice(chunk.first, chunk.rows)
                score = model.forward(*passages(chunk))["score"].astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score)], names=["doc_id", "held_out", "score"]
                )

    return rows.mapInArrow(rate, SCORES).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out, then score all documents."""
    return scores(docs, fit(*sample(docs, labels)))
