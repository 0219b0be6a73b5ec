"""Linear referencing: positions, prefixes and durations along tracks (vertex tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concourse.functions.geometry import is_finite, norm
from concourse.operators.ordered import neighbours, ordinal_chunk, scan

# Pace in drawing units per millisecond and the duration limits.
DEFAULT_SPEED, DEFAULT_MIN_MS, DEFAULT_MAX_MS = 0.35, 900.0, 6000.0
STRETCH_ROWS = 4096


def clamp_progress(t: Column) -> Column:
    return F.when(is_finite(t), F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))).otherwise(F.lit(0.0))


def clamp_index(index: Column, count: Column) -> Column:
    """Index kept inside 0..count-1; unusable values read as zero."""
    size = F.when(is_finite(count), F.greatest(F.lit(0.0), F.floor(count).cast("double"))).otherwise(F.lit(0.0))
    value = F.when(is_finite(index), F.floor(index).cast("double")).otherwise(F.lit(0.0))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.least(size - 1, F.greatest(F.lit(0.0), value))).cast("long")


def measured(
    vertices: DataFrame, key: str, order: Sequence[str] = ("ord",), chunk: Column | None = None
) -> DataFrame:
    """Vertices with the segment that starts in them, in one scan.

    ``nx``, ``ny`` are its end (NULL for the last vertex), ``seg`` its length (zero where it has none), ``m0`` and ``m1`` the
    measures of its ends; ``total`` is the track's length, ``nth`` the vertex number from 1 and ``count`` the track's vertices.
    The end measure of a segment is the very number that the next one starts with.
    """
    chunk = chunk if chunk is not None else ordinal_chunk("ord")

    def step(row: str, before: str) -> Column:
        length = norm(F.col(row)["x"] - F.col(before)["x"], F.col(row)["y"] - F.col(before)["y"]).cast("double")
        return F.when(is_finite(length), length).otherwise(F.lit(0.0))

    upto, whole = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = (Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    own = F.when(F.col("_before").isNotNull(), step("_row", "_before")).otherwise(zero)
    local = [
        {"_before": lambda w: F.lag("_row").over(w), "_after": lambda w: F.lead("_row").over(w), "_nth": lambda w: F.row_number().over(w).cast("long")},
        {"_inner": lambda w: F.sum(own).over(w.rowsBetween(*upto))},
        {"_then": lambda w: F.lead("_inner").over(w)},
    ]
    carried = [
        {"_in": lambda w: F.lag("_last._row").over(w), "_out": lambda w: F.lead("_first._row").over(w)},
        {"_head": lambda w: F.when(F.col("_in").isNotNull(), step("_first._row", "_in")).otherwise(zero)},
        {
            "_offset": lambda w: F.coalesce(F.sum(F.col("_head") + F.col("_last._inner")).over(w.rowsBetween(*earlier)), zero) + F.col("_head"),
            "_total": lambda w: F.sum(F.col("_head") + F.col("_last._inner")).over(w.rowsBetween(*whole)),
            "_ahead": lambda w: F.coalesce(F.sum("_last._nth").over(w.rowsBetween(*earlier)), F.lit(0)),
            "_count": lambda w: F.sum("_last._nth").over(w.rowsBetween(*whole)),
        },
        {"_following": lambda w: F.lead("_offset").over(w)},
    ]
    m0 = F.col("_offset") + F.col("_inner")
    m1 = F.coalesce(F.col("_offset") + F.col("_then"), F.col("_following"), m0)
    after = F.coalesce("_after", "_out")
    out = {"nx": after["x"], "ny": after["y"], "m0": m0, "m1": m1, "total": F.col("_total"), "nth": F.col("_ahead") + F.col("_nth"), "count": F.col("_count")}
    run = scan(vertices, [key], order, chunk, local, carried, out)
    length = norm(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")).cast("double")
    return run.withColumn("seg", F.when(is_finite(length), length).otherwise(zero))


def cumulative(vertices: DataFrame, key: str, order=("ord",), chunk: Column | None = None) -> DataFrame:
    """Measure of every vertex along its track."""
    return measured(vertices, key, order, chunk).select(*vertices.columns, F.col("m0").alias("measure"))


def _stretch(measure: Column) -> Column:
    """Number of the stretch of a track that a measure lies in; stretches are equally long, about one for each
    ``STRETCH_ROWS`` vertices, so that no search and no join has to take a whole track."""
    stretches = F.ceil(F.col("count") / STRETCH_ROWS)
    share = F.coalesce(F.try_divide(measure, F.col("total")), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(stretches - 1, F.floor(share * stretches))).cast("long")


def _asked(m: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Requests with their target measure; each meets one row of its track, never the vertices."""
    start = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    tracks = m.groupBy(key).agg(
        F.max("total").alias("total"),
        F.max("count").alias("count"),
        F.min_by(start, "nth").alias("_opening"),
        F.min_by(start, F.when(F.col("seg") > 0, F.col("nth"))).alias("_moving"),
    )
    asked = progress.select(key, "request_id", clamp_progress(F.col("t")).alias("t")).join(tracks, key)
    return asked.withColumn("target", F.col("total") * F.col("t")).withColumn("stretch", _stretch(F.col("target")))


def point_at(
    vertices: DataFrame, progress: DataFrame, key: str, order=("ord",), chunk: Column | None = None
) -> DataFrame:
    """Point at a fraction of the track: progress(key, request_id, t) -> (request_id, key, x, y).

    Requests and segments are merged in order of their measure and the latest segment is carried forward to the requests
    behind it, so the work is that of one ordered scan however many requests a track has.  A target on a vertex takes the
    segment that ends there; a track without length gives its first point.
    """
    m = measured(vertices, key, order, chunk)
    real = {c: F.col(c).cast("double") for c in ("x", "y", "nx", "ny")}
    none = F.lit(None)
    segments = m.filter("seg > 0").withColumns(real).select(
        key, F.col("m0").alias("measure"), F.lit(1).alias("kind"), none.cast(progress.schema["request_id"].dataType).alias("request_id"),
        F.struct("x", "y", "nx", "ny", "m0", "seg").alias("segment"), F.struct(none.cast("double").alias("x"), none.cast("double").alias("y")).alias("start"),
        _stretch(F.col("m0")).alias("stretch"),
    )
    asked = _asked(m, progress, key)
    requests = asked.select(
        key, F.col("target").alias("measure"), F.lit(0).alias("kind"), "request_id", none.cast(segments.schema["segment"].dataType).alias("segment"),
        F.coalesce("_moving", "_opening").alias("start"), "stretch",
    )
    merged = neighbours(segments.union(requests), [key], ["measure", "kind", "request_id"], F.col("stretch"), known={"_on": F.col("segment")})
    on = F.col("_on")
    ratio = F.least(F.lit(1.0), F.try_divide(F.col("measure") - on["m0"], on["seg"]))
    place = [F.coalesce(on[c] + (on[f"n{c}"] - on[c]) * ratio, F.col("start")[c]).alias(c) for c in ("x", "y")]
    return merged.filter("kind = 0").select("request_id", key, *place)


def clip_track(
    vertices: DataFrame, progress: DataFrame, key: str, order=("ord",), chunk: Column | None = None
) -> DataFrame:
    """Prefix of each track up to a fraction, ending in the interpolated point.

    Returns request_id, key, the order columns of the vertex that opened the row, ``part`` (0 vertex,
    1 cut point) and x, y.  A full fraction keeps the whole track, even one without length.
    A request meets the stretches up to its target, so only one stretch of a track is read beyond what it returns.
    """
    m = measured(vertices, key, order, chunk)
    asked = _asked(m, progress, key)
    m = m.withColumn("stretch", _stretch(F.col("m0"))).drop("total", "count")
    asked = asked.select(key, "request_id", "t", "target", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stretch"))).alias("stretch"))
    m = m.join(asked, [key, "stretch"])
    is_first = F.col("nth") == 1
    full = F.col("t") >= 1
    flat = F.col("total") <= 0
    # A vertex shows once the segment that ends in it is passed and has length.
    passed = F.when(flat, F.lit(False)).otherwise((F.col("seg") > 0) & (F.col("target") >= F.col("m1")))
    cut = ~flat & (F.col("seg") > 0) & (F.col("target") > F.col("m0")) & (F.col("target") < F.col("m1"))
    ratio = F.try_divide(F.col("target") - F.col("m0"), F.col("seg"))

    def vertex(part: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), x.cast("double").alias("x"), y.cast("double").alias("y"))

    nothing = F.array().cast("array<struct<part:int,x:double,y:double>>")
    own = F.array(vertex(0, F.col("x"), F.col("y")))
    end = F.array(vertex(1, F.col("nx"), F.col("ny")))
    mid = F.array(
        vertex(
            2,
            F.col("x") + (F.col("nx") - F.col("x")) * ratio,
            F.col("y") + (F.col("ny") - F.col("y")) * ratio,
        )
    )
    shown = F.when(full, own).otherwise(
        F.concat(
            F.when(is_first, own).otherwise(nothing),
            F.when(passed, end).when(cut, mid).otherwise(nothing),
        )
    )
    rows = m.select("request_id", key, *order, F.explode(shown).alias("_v"))
    return rows.select("request_id", key, *order, "_v.*")


def traverse_ms(
    lengths: DataFrame,
    speed: Column | float | None = None,
    low: Column | float | None = None,
    high: Column | float | None = None,
) -> DataFrame:
    """Duration from length, kept inside the limits; unusable options fall back to the defaults."""

    def number(v):
        return v.cast("double") if isinstance(v, Column) else F.lit(v).cast("double")

    pace, lo, hi = number(speed), number(low), number(high)
    pace = F.when(is_finite(pace) & (pace > 0), pace).otherwise(F.lit(DEFAULT_SPEED))
    lo = F.when(is_finite(lo), F.greatest(F.lit(0.0), lo)).otherwise(F.lit(DEFAULT_MIN_MS))
    hi = F.when(is_finite(hi), F.greatest(lo, hi)).otherwise(F.lit(DEFAULT_MAX_MS))
    duration = F.least(hi, F.greatest(lo, F.try_divide(F.col("length"), pace)))
    return lengths.withColumn("duration_ms", duration)
