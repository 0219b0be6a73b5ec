"""Ordered scans that stay parallel when one key owns a large share of the rows.

A plain ``Window.partitionBy(key)`` sorts the whole key in one task.  Here every key is cut into chunks that follow the
order (an ordinal divided by a constant, a truncated timestamp, ...).  One exchange deals the rows by ``(key, chunk)``; the
scan runs in each chunk, the first and last scanned row of every chunk are its summary, and the prefix of the summaries
carries the state across chunk borders.

The scan and its summaries are two readers of one exchange.  Both ask for whole rows and for the same filter, so Spark
finds the exchanges equal and runs one of them (a ReusedExchange): the input of a scan is evaluated once, also where scans
are stacked.  ``chunk`` must never decrease along ``order`` within a key; rows with a NULL key or chunk take no part.

Where keys are small groups that lie whole in a slice (``session.grouped``), a key is one window and has no chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from concourse.session import partitions, whole_groups

CHUNK_ROWS = 65536
Made = Callable[[WindowSpec], Column]
BEFORE, UPTO, ALL = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0), (Window.unboundedPreceding, Window.unboundedFollowing)


def ordinal_chunk(ord_col: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk for an integer ordinal column."""
    return F.floor(F.col(ord_col) / F.lit(rows)).cast("long")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    local: Sequence[dict[str, Made]],
    carried: Sequence[dict[str, Made]],
    out: dict[str, Column],
) -> DataFrame:
    """``df`` with the columns ``out``, made from ``local`` and ``carried`` ones.

    ``local``: step by step, windows over the rows of a chunk in order; ``_row`` is the whole row.  ``carried``: the same
    over the chunks of a key in order; ``_first`` and ``_last`` are a chunk's first and last row with its local columns.
    """
    keys, order = list(keys), list(order)
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "_chunk"]])
    dealt = df.withColumn("_chunk", chunk).filter(there).repartition(*keys, "_chunk")
    dealt = dealt.withColumn("_row", F.struct(*[F.col(c) for c in df.columns]))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    # The row comes out of the window as a whole and is asked for as a whole, whichever of its columns are read later.
    scanned = dealt.withColumn("_own", F.lag("_row", 0).over(inside))
    for step in local:
        scanned = scanned.withColumns({name: make(inside) for name, make in step.items()})
    made = [name for step in local for name in step]
    rank, seen = F.struct(*order), F.struct("_row", *made)
    sums = scanned.groupBy(*keys, "_chunk").agg(F.min_by(seen, rank).alias("_first"), F.max_by(seen, rank).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    for step in carried:
        sums = sums.withColumns({name: make(across) for name, make in step.items()})
    sums = sums.select(*keys, "_chunk", *[name for step in carried for name in step])
    joined = scanned.filter("_own is not null").select(*keys, "_chunk", "_own", *made).join(sums, [*keys, "_chunk"])
    own = [F.col(c) if c in keys else F.col("_own")[c].alias(c) for c in df.columns]
    return joined.select(*own, *[c.alias(name) for name, c in out.items()])


def _known(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """The rows that take part in a scan."""
    return df.filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in [*[F.col(k) for k in keys], chunk]]))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    prev: dict[str, str] | None = None,
    next: dict[str, str] | None = None,
    prev2: dict[str, str] | None = None,
    first: dict[str, str] | None = None,
    known: dict[str, Column] | None = None,
) -> DataFrame:
    """Add columns of other rows of the key: ``prev={"new": "existing"}`` of the row before, ``next`` of the one after,
    ``prev2`` of the row two before, ``first`` of the first one, and ``known`` the latest non-NULL value of the rows strictly
    before; NULL where there is no such row."""
    prev, next, prev2, first, known = prev or {}, next or {}, prev2 or {}, first or {}, known or {}
    if whole_groups(df):
        w = Window.partitionBy(*keys).orderBy(*order)
        beside = {name: F.lag(c).over(w) for name, c in prev.items()} | {name: F.lag(c, 2).over(w) for name, c in prev2.items()}
        beside |= {name: F.lead(c).over(w) for name, c in next.items()} | {name: F.first(c).over(w.rowsBetween(*UPTO)) for name, c in first.items()}
        beside |= {name: F.last(v, ignorenulls=True).over(w.rowsBetween(*BEFORE)) for name, v in known.items()}
        return _known(df, keys, chunk).select("*", *[c.alias(name) for name, c in beside.items()])
    local: dict[str, Made] = {}
    step: dict[str, Made] = {}
    if prev or prev2:
        local["_before"] = lambda w: F.lag("_row").over(w)
        step["_carry_in"] = lambda w: F.lag("_last").over(w)
    if prev2:
        local["_before2"] = lambda w: F.lag("_row", 2).over(w)
        step["_carry_in2"] = lambda w: F.lag("_last", 2).over(w)
    if next:
        local["_after"] = lambda w: F.lead("_row").over(w)
        step["_carry_out"] = lambda w: F.lead("_first").over(w)
    if first:
        step["_start"] = lambda w: F.first("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = {name: F.coalesce(F.col("_before"), F.col("_carry_in._row"))[c] for name, c in prev.items()}
    if prev2:
        # The second row of a chunk looks at the last one before; the first at that row's own predecessor.
        far = F.when(F.col("_before").isNotNull(), F.col("_carry_in._row")).otherwise(
            F.coalesce(F.col("_carry_in._before"), F.col("_carry_in2._row"))
        )
        out |= {name: F.coalesce(F.col("_before2"), far)[c] for name, c in prev2.items()}
    out |= {name: F.coalesce(F.col("_after"), F.col("_carry_out._row"))[c] for name, c in next.items()}
    out |= {name: F.col("_start._row")[c] for name, c in first.items()}
    # Upto the row itself: the last row of a chunk then tells what the chunk passes on.
    for i, (name, value) in enumerate(known.items()):
        local[f"_known{i}"] = lambda w, v=value: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        local[f"_upto{i}"] = lambda w, v=value: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        step[f"_from{i}"] = lambda w, i=i: F.last(f"_last._upto{i}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out[name] = F.coalesce(f"_known{i}", f"_from{i}")
    return scan(df, keys, order, chunk, [local], [step], out)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    name: str,
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sum per key as ``name``; ``total`` also adds the key's whole sum."""
    step: dict[str, Made] = {"_offset": lambda w: F.sum("_last._local").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    if total:
        step["_total"] = lambda w: F.sum("_last._local").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    zero = F.lit(0)
    out = {name: F.coalesce("_local", zero) + F.coalesce("_offset", zero)}
    if total:
        out[total] = F.coalesce("_total", zero)
    local: dict[str, Made] = {"_local": lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))}
    return scan(df, keys, order, chunk, [local], [step], out)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, Column], totals: dict[str, str] | None = None
) -> DataFrame:
    """Inclusive running sums of several values in one scan; ``totals={"new": "name"}`` adds whole sums of some of them."""
    totals = totals or {}
    if whole_groups(df):
        w, zero = Window.partitionBy(*keys).orderBy(*order), F.lit(0)
        sums = {n: F.sum(v).over(w.rowsBetween(*UPTO)) for n, v in values.items()} | {t: F.sum(values[n]).over(w.rowsBetween(*ALL)) for t, n in totals.items()}
        return _known(df, keys, chunk).select("*", *[F.coalesce(c, zero).alias(name) for name, c in sums.items()])
    before, whole = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.unboundedFollowing)
    local: dict[str, Made] = {
        f"_local_{n}": lambda w, v=v: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, v in values.items()
    }
    step: dict[str, Made] = {f"_offset_{n}": lambda w, n=n: F.sum(f"_last._local_{n}").over(w.rowsBetween(*before)) for n in values}
    step |= {f"_total_{t}": lambda w, n=n: F.sum(f"_last._local_{n}").over(w.rowsBetween(*whole)) for t, n in totals.items()}
    zero = F.lit(0)
    out = {n: F.coalesce(f"_local_{n}", zero) + F.coalesce(f"_offset_{n}", zero) for n in values}
    out |= {t: F.coalesce(f"_total_{t}", zero) for t in totals}
    return scan(df, keys, order, chunk, [local], [step], out)


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Greatest ``value`` of the rows strictly before; NULL for the first row of a key."""
    if whole_groups(df):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*BEFORE)
        return _known(df, keys, chunk).withColumn(name, F.max(value).over(w))
    local: dict[str, Made] = {
        "_local": lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_upto": lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }
    step: dict[str, Made] = {"_before": lambda w: F.max("_last._upto").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    return scan(df, keys, order, chunk, [local], [step], {name: F.greatest("_local", "_before")})


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str
) -> DataFrame:
    """1-based position of every row within its key; ``order`` must be unique within a key."""
    return running_sum(df, keys, order, chunk, F.lit(1).cast("long"), name)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Latest non-NULL ``value`` of the rows strictly before the current one."""
    return neighbours(df, keys, order, chunk, known={name: value})


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, opens: Callable[[Column, Column], Column], name: str
) -> DataFrame:
    """Number of the run that each row lies in.  ``opens(row, before)`` tells whether a row starts a new run; the first one
    of a key always does.  In a chunk only the first row waits for the row before; all others are counted in the scan."""

    def flag(row: str, before: str) -> Column:
        return F.coalesce(opens(F.col(row), F.col(before)), F.lit(True)).cast("long")

    if whole_groups(df):
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = _known(df, keys, chunk).withColumn("_row", F.struct(*[F.col(c) for c in df.columns])).withColumn("_before", F.lag("_row").over(w))
        return rows.select(*df.columns, F.sum(flag("_row", "_before")).over(w.rowsBetween(*UPTO)).alias(name))
    inner = F.when(F.col("_before").isNotNull(), flag("_row", "_before")).otherwise(F.lit(0))
    local: list[dict[str, Made]] = [
        {"_before": lambda w: F.lag("_row").over(w)},
        {"_inner": lambda w: F.sum(inner).over(w.rowsBetween(Window.unboundedPreceding, 0))},
    ]
    carried: list[dict[str, Made]] = [
        {"_carry_in": lambda w: F.lag("_last._row").over(w)},
        {"_head": lambda w: F.when(F.col("_carry_in").isNull(), F.lit(1)).otherwise(flag("_first._row", "_carry_in"))},
        {"_offset": lambda w: F.sum(F.col("_head") + F.col("_last._inner")).over(w.rowsBetween(Window.unboundedPreceding, -1))},
    ]
    return scan(df, keys, order, chunk, local, carried, {name: F.coalesce("_offset", F.lit(0)) + F.col("_head") + F.col("_inner")})


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key; a combining aggregate, so a hot key never meets in one sort."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, tie: Sequence[str], salts: int | None = None
) -> DataFrame:
    """First ``k`` rows per key with a ``rank`` column.

    Each salted slice keeps its own first ``k``; only those meet per key, which is exact.
    """
    sliced = df.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(salts or partitions(df))))
    by_slice = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = sliced.withColumn("_rank", F.row_number().over(by_slice)).filter(F.col("_rank") <= k).drop("_rank", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
