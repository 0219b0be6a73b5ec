"""Directory search for batches of queries.

Scores follow one ladder: compact code (0 equal, 15 prefix), whole field (5 equal, 20 prefix, 30 inside,
plus the field's weight), and all terms (40 plus the mean of the best term scores and weights).

Matching runs on the vocabulary of distinct tokens first: equality and prefixes are equi-joins on
exploded leading substrings, typing errors equi-joins on deletion variants, or on pieces and their places
where terms are long.  Places come in only
through the rarest term of a query, so a word that a third of all places carries is never joined by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.functions import text as tx
from concourse.operators.ordered import row_numbers, top_k
from concourse.session import cut, partitions, sized

# Score ladder and typo limits.
CODE_EQUAL, CODE_PREFIX = 0.0, 15.0
FIELD_EQUAL, FIELD_PREFIX, FIELD_INSIDE = 5.0, 20.0, 30.0
TERMS_BASE = 40.0
TOKEN_PREFIX, TOKEN_FUZZY = 3, 10
FUZZY_MIN, FUZZY_WIDE_MIN = 3, 6
#: The most edits a term may have, and the length from which terms meet by pieces instead of deletion variants: those
#: grow with the square of the length.
WIDEST, PIECED_MIN = 2, 24
GRAM = 3


def _letters(value: Column, first: Column, last: Column) -> Column:
    ends = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda n: F.substring(value, F.lit(1), n))


def prepare_queries(queries: DataFrame) -> DataFrame:
    """query_id, lang, text -> normalised text, terms and space-free form."""
    q = queries.select("query_id", tx.resolve_language(F.col("lang")).alias("lang"), tx.normalize_search(F.col("text")).alias("norm"))
    return q.withColumn("terms", tx.tokens(F.col("norm"))).withColumn("compact", F.replace("norm", F.lit(" "), F.lit("")))


def place_fields(places: DataFrame) -> DataFrame:
    """Searchable fields: place_id, kind (code, en, ar, alias) and normalised non-empty value.

    places: place_id, code, name_en, name_ar, aliases.
    """
    def field(kind: str, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), c.alias("raw"))

    named = F.array(field("code", F.col("code")), field("en", F.col("name_en")), field("ar", F.col("name_ar")))
    other = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: field("alias", a))
    spread = places.select("place_id", F.explode(F.concat(named, other)).alias("f"))
    return spread.select("place_id", F.col("f.kind").alias("kind"), tx.normalize_search(F.col("f.raw")).alias("value")).filter(
        "value <> ''"
    )


def field_weight(kind: Column, lang: Column) -> Column:
    return F.when(kind == "code", 0).when(kind == lang, 1).when(kind == "alias", 3).otherwise(2)


def place_tokens(fields: DataFrame) -> DataFrame:
    """Distinct (place_id, kind, token).  A few compressed bytes hold very many places: fields are dealt to all slices by their
    place before they become tokens, so no task keeps the tokens of a whole file."""
    spread = fields.select("place_id", "kind", "value").repartition(partitions(fields), "place_id")
    return spread.select("place_id", "kind", F.explode(F.array_distinct(tx.tokens(F.col("value")))).alias("token")).distinct()


def allowed_edits(term: Column) -> Column:
    return F.when(tx.utf16_length(term) >= FUZZY_WIDE_MIN, 2).otherwise(1)


def fuzzy_pairs(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, distance for pairs within the typo allowance; digits are never repaired."""
    asked = terms.filter(~tx.has_digit(F.col("term")) & (tx.utf16_length(F.col("term")) >= FUZZY_MIN))
    offered = vocabulary.filter(~tx.has_digit(F.col("token")) & (tx.utf16_length(F.col("token")) >= FUZZY_MIN - 1))

    def variants(df: DataFrame, c: str) -> DataFrame:
        wide = F.length(c) >= FUZZY_WIDE_MIN - 2
        forms = F.when(wide, tx.deletion_variants(F.col(c), 2)).otherwise(tx.deletion_variants(F.col(c), 1))
        return df.select(c, F.explode(forms).alias("form")).filter(F.length("form") >= FUZZY_MIN - 1)

    def pieces(df: DataFrame, c: str, spread: int) -> DataFrame:
        moves = F.sequence(F.lit(-spread), F.lit(spread))
        lengths = F.transform(moves, lambda d: F.length(c) + d)
        return df.select(c, F.explode(tx.positional_pieces(F.col(c), lengths, 2 * WIDEST + 1, moves)).alias("form"))

    long = F.length("term") >= PIECED_MIN
    # One term has many forms: neither side is small because its terms are few.
    short = variants(asked.filter(~long), "term").hint("merge")
    short = short.join(variants(offered.filter(F.length("token") < PIECED_MIN + WIDEST), "token").hint("merge"), "form")
    # An edit touches one piece, a swap two that are neighbours: of 2 * WIDEST + 1 pieces one is whole, moved by WIDEST at most.
    far = pieces(offered.filter(F.length("token") >= PIECED_MIN - WIDEST), "token", WIDEST).hint("merge")
    near = short.select("term", "token").unionByName(pieces(asked.filter(long), "term", 0).hint("merge").join(far, "form").select("term", "token")).distinct()
    allowed = allowed_edits(F.col("term"))
    gap = F.abs(tx.utf16_length(F.col("term")) - tx.utf16_length(F.col("token")))
    scored = near.filter(gap <= allowed).withColumn("distance", tx.bounded_osa(F.col("term"), F.col("token"), allowed))
    return scored.filter("distance is not null")


def token_scores(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, score: equal 0, prefix 3, fuzzy 10 + distance; pairs that do not match are absent."""
    equal = terms.join(vocabulary, F.col("term") == F.col("token")).select("term", "token", F.lit(0).alias("score"))
    heads = vocabulary.select("token", F.explode(_letters(F.col("token"), F.lit(1), F.length("token") - 1)).alias("term"))
    prefix = heads.join(terms, "term").select("term", "token", F.lit(TOKEN_PREFIX).alias("score"))
    typo = fuzzy_pairs(terms, vocabulary).select("term", "token", (F.lit(TOKEN_FUZZY) + F.col("distance")).alias("score"))
    return equal.unionByName(prefix).unionByName(typo).groupBy("term", "token").agg(F.min("score").alias("score"))


def query_terms(prepared: DataFrame) -> DataFrame:
    return prepared.select(
        "query_id", "lang", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("term_ix", "term")
    )


def all_terms(terms: DataFrame, tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """query_id, place_id, score for places where every term of the query matches some token."""
    asked = terms.join(matches, "term").select("query_id", "lang", "n_terms", "term_ix", "token", "score")
    carried = tokens.select("place_id", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("carriers"))
    cost = (
        asked.join(carried, "token")
        .groupBy("query_id", "n_terms", "term_ix")
        .agg(F.sum("carriers").alias("carriers"))
        .groupBy("query_id", "n_terms")
        .agg(F.count(F.lit(1)).alias("matched"), F.min_by("term_ix", F.struct("carriers", "term_ix")).alias("term_ix"))
        .filter("matched = n_terms")
        .select("query_id", "term_ix")
    )
    seeds = asked.join(cost, ["query_id", "term_ix"]).select("query_id", "token")
    candidates = seeds.join(tokens.select("place_id", "token"), "token").select("query_id", "place_id").distinct()
    hits = candidates.join(tokens, "place_id").join(asked, ["query_id", "token"])
    weighted = F.col("score") + field_weight(F.col("kind"), F.col("lang"))
    best = hits.groupBy("query_id", "place_id", "n_terms", "term_ix").agg(F.min(weighted).alias("best"))
    return (
        best.groupBy("query_id", "place_id", "n_terms")
        .agg(F.count(F.lit(1)).alias("matched"), F.sum("best").alias("total"))
        .filter("matched = n_terms")
        .select("query_id", "place_id", (F.lit(TERMS_BASE) + F.col("total") / F.col("n_terms")).alias("score"))
    )


def _inside_tokens(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token pairs where the token contains the term, met on the term's rarest letter group."""
    def grams(df: DataFrame, c: str, size: Column) -> DataFrame:
        starts = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1)).otherwise(
            F.array().cast("array<int>")
        )
        pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(c), i, size)))
        return df.select(c, F.explode(pieces).alias("gram"))

    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    index = grams(vocabulary.withColumn("_n", F.explode(sizes)), "token", F.col("_n"))
    asked = grams(terms, "term", F.least(F.length("term"), F.lit(GRAM)))
    spread = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = asked.join(spread, "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return chosen.join(index, "gram").filter(F.contains("token", "term")).select("term", "token")


def field_scores(prepared: DataFrame, fields: DataFrame, tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """query_id, place_id, score of the whole query against whole fields (equal, prefix, inside).

    A field holding a several-term query ends one token with its first term and starts another with
    its last; the rarer of the two finds the candidates.  One term may sit anywhere in a token.
    """
    vocabulary = tokens.select("token").distinct()
    n = F.size("terms")
    first, last = F.element_at("terms", 1), F.element_at("terms", -1)
    many = prepared.filter(n > 1).select("query_id", first.alias("first"), last.alias("last"))
    tails = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(F.col("token"), i, F.length("token")))
    suffix = vocabulary.select("token", F.explode(tails).alias("first")).join(many, "first")
    heads = matches.filter(F.col("score") <= TOKEN_PREFIX).select(F.col("term").alias("last"), "token").join(many, "last")
    ways = suffix.select("query_id", F.lit("first").alias("way"), "token").unionByName(
        heads.select("query_id", F.lit("last").alias("way"), "token")
    )
    carried = tokens.select("place_id", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("carriers"))
    chosen = (
        ways.join(carried, "token")
        .groupBy("query_id", "way")
        .agg(F.sum("carriers").alias("carriers"))
        .groupBy("query_id")
        .agg(F.min_by("way", F.struct("carriers", "way")).alias("way"))
    )
    single = prepared.filter(n == 1).select("query_id", first.alias("term"))
    lettered = single.filter(~tx.has_digit(F.col("term")))
    inside = _inside_tokens(lettered.select("term").distinct(), vocabulary).join(lettered, "term").select("query_id", "token")
    starts = matches.filter(F.col("score") <= TOKEN_PREFIX).join(single.filter(tx.has_digit(F.col("term"))), "term")
    seeds = (
        ways.join(chosen, ["query_id", "way"])
        .select("query_id", "token")
        .unionByName(inside)
        .unionByName(starts.select("query_id", "token"))
    )
    found = seeds.join(tokens.select("place_id", "token"), "token").select("query_id", "place_id").distinct()
    pairs = found.join(fields, "place_id").join(prepared.select("query_id", "lang", "norm"), "query_id")
    value, norm = F.col("value"), F.col("norm")
    base = (
        F.when(value == norm, FIELD_EQUAL)
        .when(F.startswith(value, norm), FIELD_PREFIX)
        .when(~tx.has_digit(norm) & F.contains(value, norm), FIELD_INSIDE)
    )
    scored = pairs.withColumn("score", base + field_weight(F.col("kind"), F.col("lang"))).filter("score is not null")
    return scored.groupBy("query_id", "place_id").agg(F.min("score").alias("score"))


def compact_code_scores(prepared: DataFrame, fields: DataFrame) -> DataFrame:
    """query_id, place_id, score of the space-free query against space-free codes."""
    codes = fields.filter("kind = 'code'").select("place_id", F.replace("value", F.lit(" "), F.lit("")).alias("code"))
    heads = codes.select("place_id", "code", F.explode(_letters(F.col("code"), F.lit(1), F.length("code"))).alias("compact"))
    asked = prepared.filter("compact <> ''").select("query_id", "compact")
    score = F.when(F.col("code") == F.col("compact"), CODE_EQUAL).otherwise(CODE_PREFIX)
    return heads.join(asked, "compact").select("query_id", "place_id", score.alias("score"))



def everything(prepared: DataFrame, places: DataFrame) -> DataFrame:
    """Empty queries list the whole directory, as many rows as places; slices of the places share the work."""
    slices = partitions(places)
    blank = prepared.filter("norm = ''").select(
        "query_id", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice")
    )
    spread = places.select("place_id", F.pmod(F.xxhash64("place_id"), F.lit(slices)).cast("int").alias("_slice"))
    return blank.join(spread, "_slice").select("query_id", "place_id", F.lit(0.0).alias("score"))


class Directory:
    """Searchable form of a place table, materialised once and shared by any number of query batches."""

    def __init__(self, places: DataFrame):
        self.places = sized(places.select("place_id", "ord"))
        self.fields = sized(place_fields(places))
        self.tokens = sized(place_tokens(self.fields))
        self.vocabulary = self.tokens.select("token").distinct()


def search_scores(queries: DataFrame, directory: Directory) -> DataFrame:
    """Best score of every matching (query_id, place_id)."""
    prepared = sized(prepare_queries(queries))
    fields, tokens = directory.fields, directory.tokens
    terms = query_terms(prepared)
    matches = sized(token_scores(terms.select("term").distinct(), directory.vocabulary))
    scores = (
        all_terms(terms, tokens, matches)
        .unionByName(field_scores(prepared, fields, tokens, matches))
        .unionByName(compact_code_scores(prepared, fields))
        .unionByName(everything(prepared, directory.places))
    )
    return scores.groupBy("query_id", "place_id").agg(F.min("score").alias("score"))


def search(queries: DataFrame, places: DataFrame | Directory, k: int | None = None) -> DataFrame:
    """Ranked matches per query: best score first, ties in directory order (``ord`` of places).

    Without ``k`` every match is ranked; with it, only the first ``k`` per query are kept.
    """
    directory = places if isinstance(places, Directory) else Directory(places)
    hits = search_scores(queries, directory).join(directory.places, "place_id")
    return rank(cut(hits), k) if k is None else rank(hits, k)


def rank(hits: DataFrame, k: int | None = None) -> DataFrame:
    if k is not None:
        return top_k(hits, ["query_id"], [F.col("score"), F.col("ord")], k, ["place_id"])
    chunk = F.struct(F.col("score").alias("s"), F.floor(F.col("ord") / 65536).alias("o"))
    return row_numbers(hits, ["query_id"], ["score", "ord"], chunk, "rank")
