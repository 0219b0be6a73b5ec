"""Directory text: normalisation, tolerance, language rules, all as JVM column expressions."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic letter variants and digits folded for matching only.
FOLD_FROM = "أإآٱىئۍیؤکة٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
FOLD_TO = "ااااييييوكه01234567890123456789"
TATWEEL = "ـ"

HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without marks: one-letter results as a translate pair, longer ones as a map."""
    source, target, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if HANGUL_FIRST <= code <= HANGUL_LAST or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        flat = unicodedata.normalize("NFKD", char)
        if flat == char:
            continue
        bare = "".join(c for c in flat if not unicodedata.category(c).startswith("M"))
        if len(bare) == 1:
            source.append(char)
            target.append(bare)
        elif bare:
            longer[char] = bare
    return "".join(source), "".join(target), longer


MERGE_ABOVE, MERGE_GAP = 0x700, 0x100
FEW_LONGER = 16


@functools.cache
def _longer_pattern() -> str:
    """Few code ranges that cover everything decomposing to several letters.

    Beyond the common scripts nearby ranges are merged: a superset only sends a row down the
    per-character path, which is right for any text.
    """
    codes = sorted(ord(c) for c in _decompositions()[2]) + [HANGUL_FIRST, HANGUL_LAST]
    ranges: list[list[int]] = []
    for code in sorted(codes):
        gap = MERGE_GAP if code > MERGE_ABOVE else 1
        if ranges and code - ranges[-1][1] <= gap and ranges[-1][0] > MERGE_ABOVE - 1:
            ranges[-1][1] = code
        elif ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    ranges.append([HANGUL_FIRST, HANGUL_LAST])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _code_point(char: Column) -> Column:
    return F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int")


def _from_code_point(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _expand(char: Column) -> Column:
    """Several-letter decomposition of one character; Hangul syllables follow the standard arithmetic."""
    table = F.from_json(F.lit(json.dumps(_decompositions()[2])), "map<string,string>")
    index = _code_point(char) - HANGUL_FIRST
    lead = _from_code_point(F.lit(0x1100) + F.floor(index / 588).cast("int"))
    vowel = _from_code_point(F.lit(0x1161) + F.floor((index % 588) / 28).cast("int"))
    tail = F.when(index % 28 == 0, F.lit("")).otherwise(_from_code_point(F.lit(0x11A7) + index % 28))
    syllable = char.between(chr(HANGUL_FIRST), chr(HANGUL_LAST))
    return F.when(syllable, F.concat(lead, vowel, tail)).otherwise(F.coalesce(F.try_element_at(table, char), char))


def normalize_search(c: Column) -> Column:
    """Search form of a text: compatibility letters, lower case, no marks, folded Arabic, plain digits, single spaces.

    ASCII rows (as many bytes as characters) need only lower case and separators.  One-letter
    decompositions go through ``translate``.  A row with a few different ligatures, presentation forms or
    Hangul syllables has each of them replaced; the per-character path is left to rows with many.
    """
    source, target, _ = _decompositions()
    ascii_only = F.octet_length(c) == F.char_length(c)
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(_longer_pattern()), F.lit(0)))
    # Decompositions hold nothing that decomposes further, so the order of the replacements is free.
    replaced = F.aggregate(found, c, lambda text, ch: F.replace(text, ch, _expand(ch)))
    expanded = F.when(F.size(found) <= FEW_LONGER, replaced).otherwise(F.array_join(F.transform(chars, _expand), ""))
    flat = F.translate(F.when(c.rlike(_longer_pattern()), expanded).otherwise(c), source, target)
    bare = F.regexp_replace(F.lower(flat), r"\p{M}", "")
    folded = F.translate(bare, FOLD_FROM + TATWEEL, FOLD_TO)
    full = F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    return F.trim(F.when(ascii_only, plain).otherwise(full))


def tokens(normalized: Column) -> Column:
    """Terms of a normalised text; empty text has none."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: supplementary characters count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: edits plus adjacent swaps, no substring edited twice."""
    left = F.filter(F.split(a, ""), lambda ch: ch != "")
    right = F.filter(F.split(b, ""), lambda ch: ch != "")
    first_row = F.transform(F.sequence(F.lit(0), F.size(right)), lambda j: j)
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit("").alias("char"),
        F.array().cast("array<int>").alias("older"),
        first_row.alias("row"),
    )

    def next_row(state: Column, ch: Column) -> Column:
        def cell(row: Column, target: Column) -> Column:
            j = F.size(row)
            step = F.least(
                F.element_at(state["row"], j + 1) + 1,
                F.element_at(row, -1) + 1,
                F.element_at(state["row"], j) + F.when(ch == target, 0).otherwise(1),
            )
            swapped = (
                (state["i"] > 0)
                & (j > 1)
                & (ch == F.try_element_at(right, F.greatest(j - 1, F.lit(1))))
                & (state["char"] == target)
            )
            swap_cost = F.try_element_at(state["older"], F.greatest(j - 1, F.lit(1))) + 1
            best = F.when(F.coalesce(swapped, F.lit(False)), F.least(step, swap_cost)).otherwise(step)
            return F.concat(row, F.array(best))

        row = F.aggregate(right, F.array(state["i"] + 1), cell)
        return F.struct(
            (state["i"] + 1).alias("i"), ch.alias("char"), state["row"].alias("older"), row.alias("row")
        )

    return F.aggregate(left, start, next_row, lambda state: F.element_at(state["row"], -1))


def bounded_osa(a: Column, b: Column, allowed: Column) -> Column:
    """OSA distance when it is at most ``allowed``, else NULL.

    Levenshtein brackets it (``osa <= lev <= 2 * osa``): at most one edit is already exact, and
    anything above twice the allowance cannot qualify, so the alignment runs only in between.
    """
    lev = F.levenshtein(a, b)
    exact = F.when(lev <= 1, lev).when(lev <= 2 * allowed, osa(a, b))
    return F.when(exact <= allowed, exact)


def deletion_variants(token: Column, depth: int = 2) -> Column:
    """The token and everything reachable by deleting up to ``depth`` (1 or 2) characters."""

    def without_one(t: Column) -> Column:
        cuts = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
        return F.transform(cuts, lambda i: F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, F.length(t))))

    once = without_one(token)
    groups = [F.array(token), once]
    if depth > 1:
        groups.append(F.flatten(F.transform(once, without_one)))
    return F.array_distinct(F.concat(*groups))


def positional_pieces(text: Column, lengths: Column, parts: int, shifts: Column) -> Column:
    """``ARRAY<STRUCT<length, part, piece>>``: what of ``text`` stands where a text of each of the ``lengths``, cut into ``parts``
    about equal pieces, has its pieces, moved by each of the ``shifts``; places beyond the text give nothing."""

    def of_length(n: Column) -> Column:
        def of_part(j: Column) -> Column:
            start = F.floor(j * n / parts).cast("int")
            width = F.floor((j + 1) * n / parts).cast("int") - start
            there = F.filter(shifts, lambda d: (start + d >= 0) & (start + d + width <= F.length(text)))
            return F.transform(there, lambda d: F.struct(n.alias("length"), j.alias("part"), F.substring(text, start + d + 1, width).alias("piece")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), of_part))

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def resolve_language(c: Column) -> Column:
    """``ar`` for Arabic locale tags (any case, ``_`` or ``-``), else ``en``; NULL is ``en``."""
    locale = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    return F.when(locale.rlike(r"^ar(?:-[a-z0-9]{1,8})*\z"), F.lit("ar")).otherwise(F.lit("en"))


def text_direction(c: Column) -> Column:
    return F.when(resolve_language(c) == "ar", F.lit("rtl")).otherwise(F.lit("ltr"))


def canonical_name(c: Column) -> Column:
    """Single-spaced title case where every letter after a non-letter is upper-cased (``M&E Room``)."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    runs = F.regexp_extract_all(flat, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    titled = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, F.length(r))))
    )
    return F.array_join(titled, "")


def without_full_stop(c: Column) -> Column:
    return F.regexp_replace(c, r"\.$", "")
