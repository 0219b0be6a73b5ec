"""Conversations as training windows of a bounded number of tokens, with a loss mask.

Prefix sums of the turns' tokens choose the windows.  With ``room`` tokens left for new turns, the turns whose prefix
sum falls into the same stride of ``room`` tokens form a window; a turn that would pass the end of its stride stands in
a window of its own, so a window exceeds the budget only where a single turn does.  Every later window starts with the
system turn again (when it fits half the budget) and with the turns before it that fit the history budget; their
targets are masked, so each assistant text is a target once.  Prefix sums are taken per run of ``RUN`` turns and then
across runs, so that one long conversation is not one task's.  Only DataFrame expressions are used.

The template writes a turn as ``<|im_start|>role<|im_sep|>text<|im_end|>``.  A backslash goes before every backslash
and after the first character of every control string inside a role or text, so that no control string stands there;
dropping each backslash before its character restores the input.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then role and text; repeated rows
are turns of their own; a null ``conv_id`` is a conversation like any other; an empty table gives no windows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template: its own marks, then those of another public format.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (OPEN, SEP, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TARGET = "assistant"
SYSTEM = "system"
RUN = 1024


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and how many of them repeated history may take."""

    window: int = 2048
    history: int = 256


def token_count(text: Column) -> Column:
    """Words and single marks of a text, and three tokens for the turn's own marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 3


def escape(text: Column) -> Column:
    rest = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROLS)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={rest})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _placed(turns: DataFrame, budget: Budget) -> DataFrame:
    """Turns with their ordinal, prefix sum, the size of the system turn and the window they belong to.

    ``key`` wraps the conversation's id, so that a null id is a key like any other.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = turns.select(F.struct("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    run = F.coalesce(F.floor(F.col("turn") / RUN).cast("long"), F.lit(-(1 << 62)))
    base = base.withColumns({"tokens": token_count(F.col("text")).cast("long"), "run": run})
    order = ["turn", "role", "text"]
    here = Window.partitionBy("key", "run").orderBy(*order)
    local = base.withColumn("place", F.row_number().over(here)).withColumn(
        "before", F.sum("tokens").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    )
    first = F.min_by(F.struct("role", "text", "tokens"), F.struct(*order))
    sums = base.groupBy("key", "run").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), first.alias("first"))
    across = Window.partitionBy("key").orderBy("run")
    ahead = across.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.first("first").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = (F.col("opening.role") == SYSTEM) & (F.col("opening.tokens") <= budget.window // 2)
    sums = sums.withColumn("opening", opening).select(
        "key",
        "run",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_ahead"),
        F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("sum_ahead"),
        F.when(kept, F.col("opening.text")).alias("system"),
        F.when(kept, F.col("opening.tokens")).otherwise(0).alias("system_tokens"),
    )
    rows = local.join(sums, ["key", "run"])
    rows = rows.select(
        "key",
        "role",
        "text",
        "tokens",
        (F.col("n_ahead") + F.col("place") - 1).alias("ordinal"),
        (F.col("sum_ahead") + F.col("before")).alias("before"),
        "system",
        F.greatest(F.lit(budget.window - budget.history) - F.col("system_tokens"), F.lit(1)).alias("room"),
    )
    stride = F.floor(F.col("before") / F.col("room")).cast("long")
    passes = F.col("before") + F.col("tokens") > (stride + 1) * F.col("room")
    return rows.withColumn("own", 2 * stride + passes.cast("long"))


def windows(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """conv_id, window, formatted, n_turns (new ones), repeated (turns before them), tokens and loss spans.

    ``loss`` holds the start and end (code points of ``formatted``) of every target text.
    """
    rows = _placed(turns, budget)
    starts = rows.groupBy("key", F.col("own").alias("window")).agg(F.min("before").alias("opens"))
    starts = starts.withColumn("stride", F.floor(F.col("window") / 2).cast("long"))
    # A turn lies in its own window and is history of those that open within the history budget after it, so it meets
    # the windows of its own stride and of the few strides that the history budget reaches.
    short = F.col("tokens") <= budget.history
    stride = lambda at: F.floor(at / F.col("room")).cast("long")
    reach = F.sequence(stride(F.col("before")), stride(F.col("before") + F.when(short, F.lit(budget.history)).otherwise(0)))
    met = rows.withColumn("stride", F.explode(reach)).join(starts, ["key", "stride"])
    repeated = (F.col("window") > F.col("own")) & short & (F.col("opens") - F.col("before") <= budget.history)
    repeated = repeated & (F.col("system").isNull() | (F.col("ordinal") > 0))  # the system turn comes by itself
    met = met.filter((F.col("window") == F.col("own")) | repeated)
    head_of = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEP))
    parts = met.select(
        "key",
        "stride",
        "window",
        "tokens",
        F.when(F.col("window") > 0, F.col("system")).alias("system"),
        F.struct(
            "ordinal",
            (F.col("window") != F.col("own")).alias("repeated"),
            (F.col("role") == TARGET).alias("target"),
            head_of.alias("head"),
            escape(F.col("text")).alias("body"),
        ).alias("part"),
    )
    grouped = parts.groupBy("key", "stride", "window").agg(
        F.sort_array(F.collect_list("part")).alias("parts"), F.max("system").alias("system"), F.sum("tokens").alias("tokens"),
        F.min("part.ordinal").alias("opens"),
    )
    # A later stride whose first turn is the system turn itself does not repeat it.
    system = F.when(
        F.col("system").isNotNull() & (F.col("opens") > 0), F.concat(F.lit(OPEN + SYSTEM + SEP), escape(F.col("system")), F.lit(CLOSE))
    ).otherwise(F.lit(""))
    formatted = F.concat(system, F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    start = F.struct(F.length(system).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        spans = F.when(p["target"] & ~p["repeated"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((b + len(CLOSE)).alias("at"), spans.alias("spans"))

    return grouped.select(
        "key.conv_id",
        "window",
        formatted.alias("formatted"),
        F.size(F.filter("parts", lambda p: ~p["repeated"])).cast("long").alias("n_turns"),
        (F.size(F.filter("parts", lambda p: p["repeated"])) + (F.length(system) > 0).cast("int")).cast("long").alias("repeated"),
        "tokens",
        F.aggregate("parts", start, step)["spans"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows: n_turns, digests of its turns and of its targets, and their lengths."""
    turns = F.filter(F.split("formatted", CLOSE.replace("|", r"\|"), -1), lambda t: t.startswith(OPEN))
    fresh = F.slice(turns, F.col("repeated").cast("int") + 1, F.greatest(F.size(turns), F.lit(1)))

    def plain(turn: Column) -> Column:
        halves = F.split(F.substring(turn, len(OPEN) + 1, F.length(turn)), SEP.replace("|", r"\|"), 2)
        return F.concat(unescape(halves[0]), F.lit("\n"), unescape(halves[1]), F.lit("\n"))

    target = F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = formatted.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform(fresh, plain), "").alias("turns"),
            F.array_join(target, "").alias("loss"),
        ).alias("part"),
        F.size(fresh).alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return grouped.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
