"""Quality rules whose cutoffs follow the data: one quantile sketch per language, source and measure.

Each task counts the measures of its texts; Spark folds them into mergeable KLL sketches per (lang, source).  The
sketches of a language and of the whole corpus come from merging those, for groups of fewer than ``FEWEST`` documents.
A measure's fence lies ``REACH`` interquartile ranges beyond the quartile, where a range counts as ``spread`` at least,
so that a group of equal values does not reject its neighbours.  The fences join the documents on (lang, source), and
a document goes when it breaks a base rule or leaves any fence.

Defined cases: a null or empty text has no words and fails the base rule; null languages and sources are groups like
any other; repeated rows are judged one by one; an empty table gives an empty result; further columns pass through
``with_quality`` unless their names are those of its own columns, which then replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.llm.kernels import Chunk, SubstringHash, chunks, code_points, lines, mix, per_row, words
from concourse.llm.tables import fresh, stored

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
# Parameters of the adaptive rules.
REACH = 3.0
FEWEST = 200
SKETCH_SIZE = 400
# Measure -> (least interquartile range, whether the low side is fenced, whether the high side is).
FENCES = {
    "symbol_share": (0.01, False, True),
    "upper_share": (0.05, False, True),
    "mark_share": (0.02, False, True),
    "line_share": (0.2, False, True),
    "repeat_share": (0.15, False, True),
    "word_length": (0.5, True, True),
}
VERDICTS = ("base_failed", "outside", "kept")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?;:")] = True
_U64 = np.uint64


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def count_measures(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    n, data = chunk.rows, chunk.data
    out = {name: np.zeros(n, dtype=np.int64) for name in COUNTS}
    if not len(data):
        return out
    starts, ends, rows = words(chunk)
    points = code_points(data)
    out["n_words"] = per_row(rows, None, n)
    out["word_chars"] = per_row(rows, points[ends] - points[starts], n)
    for name, wanted in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK)):
        seen = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(wanted[data], out=seen[1:])
        out[name] = np.diff(seen[chunk.offsets])
    hashes = SubstringHash(data)
    salt = mix(np.arange(n, dtype=np.uint64) + _U64(1))
    line_start, line_end, line_row = lines(chunk)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    out["n_lines"] = per_row(line_row[has_word], None, n)
    keys = mix(hashes.of(line_start[has_word], line_end[has_word]) ^ salt[line_row[has_word]])
    distinct, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - per_row(line_row[has_word][first], None, n)
    if len(starts) > 2:
        one = hashes.of(starts, ends)
        three = mix(one[:-2] + one[1:-1] * _U64(0x9E3779B97F4A7C15) + one[2:] * _U64(0xC2B2AE3D27D4EB4F) ^ salt[rows[:-2]])
        inside = np.flatnonzero(rows[:-2] == rows[2:])
        found = inside[_repeated(three[inside])]
        covered = np.zeros(len(starts), dtype=bool)
        for step in range(3):
            covered[found + step] = True
        out["n_repeat_words"] = per_row(rows[covered], None, n)
    return out


MEASURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the counts of each text."""
    own = [c for c in docs.columns if c not in COUNTS]
    at = own.index(text)
    schema = docs.select(*own).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(at)):
                found = count_measures(chunk)
                part = batch.slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(found[c]) for c in COUNTS)], names=[*own, *COUNTS]
                )

    for name in COUNTS:
        schema = schema.add(name, "long")
    return docs.select(*own).mapInArrow(count, schema)


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _measure(name: str) -> Column:
    part, whole = MEASURES[name]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def fences(counted: DataFrame) -> DataFrame:
    """lang, source and ``<measure>_low`` / ``<measure>_high`` from merged quantile sketches of all documents."""
    groups = counted.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(_measure(m), SKETCH_SIZE).alias(m) for m in FENCES]
    )
    groups = stored(groups, "sketches")

    def merged(df: DataFrame, prefix: str) -> list[Column]:
        return [F.sum("n").alias(f"{prefix}n"), *[F.kll_merge_agg_double(m, SKETCH_SIZE).alias(prefix + m) for m in FENCES]]

    by_lang = groups.groupBy("lang").agg(*merged(groups, "lang_")).withColumnRenamed("lang", "lang_key")
    corpus = groups.groupBy().agg(*merged(groups, "all_"))
    wide = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_key")), "left").join(F.broadcast(corpus), F.lit(True))
    out = ["lang", "source"]
    for m, (spread, low, high) in FENCES.items():
        sketch = F.when(F.col("n") >= FEWEST, F.col(m)).when(F.col("lang_n") >= FEWEST, F.col("lang_" + m)).otherwise(F.col("all_" + m))
        wide = wide.withColumn("_q", F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(0.25), F.lit(0.75))))
        reach = REACH * F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(spread))
        wide = wide.withColumn(f"{m}_low", F.col("_q")[0] - reach if low else F.lit(None).cast("double"))
        wide = wide.withColumn(f"{m}_high", F.col("_q")[1] + reach if high else F.lit(None).cast("double"))
        out += [f"{m}_low", f"{m}_high"]
    return wide.select(*out)


def with_quality(docs: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Columns of ``docs``, the counts, ``base_failed``, ``outside`` (the fences a document leaves) and ``kept``.

    ``counted`` are the counts that the fences follow, with lang and source; by default those of ``docs``.
    """
    if counted is None:
        counted = stored(with_counts(docs.select("text", "lang", "source")).drop("text"), "counts")
    return _judged(with_counts(docs), fences(counted))


def _judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    lang, source, fence = (fresh(c, rows.columns) for c in ("_lang", "_source", "_fence"))
    ends = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*ends).alias(fence))
    same = F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source))
    judged = rows.join(limits, same, "left")
    broken = [
        F.when((_measure(m) < F.col(fence)[f"{m}_low"]) | (_measure(m) > F.col(fence)[f"{m}_high"]), F.lit(m)) for m in FENCES
    ]
    own = [c for c in rows.columns if c not in VERDICTS]
    judged = judged.select(
        *own, base_failed().alias("base_failed"), F.filter(F.array(*broken), lambda m: m.isNotNull()).alias("outside")
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def measured(docs: DataFrame) -> DataFrame:
    """The verdict of every document without its text: the counts are kept in the shared folder and not made twice."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    counted = stored(with_counts(rows).drop("text"), "counts")
    return _judged(counted, fences(counted))
