"""Directory search over part names with queries derived from the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.functions import text as tx
from concourse.operators import search as se
from concourse.plans import bindings as b
from concourse.plans.registry import query
from concourse.session import sized

# Query texts: shouted names, one dropped letter, two swapped letters, word endings, brand codes, mixed and blank.
QUERIES_SQL = """names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
brands AS (SELECT DISTINCT p_brand FROM part),
queries AS (
  SELECT 'shout ' || p_name AS query_id, 'en' AS lang, '  ' || upper(p_name) || '!' AS text FROM names
  UNION ALL SELECT 'drop ' || p_name, 'ar', w1[1] || w1[3:] || ' ' || w2 FROM names
  UNION ALL SELECT 'swap ' || p_name, 'en', w2[1:len(w2) - 2] || w2[len(w2)] || w2[len(w2) - 1] || ', ' || w1 FROM names
  UNION ALL SELECT DISTINCT 'tail ' || w2, 'en', w2[2:] FROM names
  UNION ALL SELECT DISTINCT 'split ' || p_name, 'en', w1[2:] || ' ' || w2[1:2] FROM names
  UNION ALL SELECT 'code ' || p_brand, 'en', replace(p_brand, '#', '') FROM brands
  UNION ALL SELECT 'mixed ' || p_brand, 'ar', 'ring ' || p_brand FROM brands
  UNION ALL SELECT DISTINCT 'blank', 'en', ' - ' FROM brands)"""


def queries(t):
    names = t.part.select("p_name").distinct()
    words = F.split("p_name", " ")
    w1, w2 = words[0], words[1]
    n = F.length(w2)

    def q(kind, key, lang, text):
        return F.struct(F.concat(F.lit(kind + " "), key).alias("query_id"), F.lit(lang).alias("lang"), text.alias("text"))

    name = F.col("p_name")
    texts = F.array(
        q("shout", name, "en", F.concat(F.lit("  "), F.upper(name), F.lit("!"))),
        q("drop", name, "ar", F.concat(F.substring(w1, 1, 1), F.substring(w1, F.lit(3), F.length(w1)), F.lit(" "), w2)),
        q(
            "swap",
            name,
            "en",
            F.concat(F.substring(w2, F.lit(1), n - 2), F.substring(w2, n, F.lit(1)), F.substring(w2, n - 1, F.lit(1)), F.lit(", "), w1),
        ),
        q("tail", w2, "en", F.substring(w2, F.lit(2), n)),
        q("split", name, "en", F.concat(F.substring(w1, F.lit(2), F.length(w1)), F.lit(" "), F.substring(w2, 1, 2))),
    )
    brand = F.col("p_brand")
    codes = F.array(
        q("code", brand, "en", F.replace(brand, F.lit("#"), F.lit(""))),
        q("mixed", brand, "ar", F.concat(F.lit("ring "), brand)),
        F.struct(F.lit("blank").alias("query_id"), F.lit("en").alias("lang"), F.lit(" - ").alias("text")),
    )
    from_names = names.select(F.explode(texts).alias("q")).select("q.*")
    from_brands = t.part.select("p_brand").distinct().select(F.explode(codes).alias("q")).select("q.*")
    return from_names.unionByName(from_brands).distinct()


def places(t):
    return b.places(t).select(
        "place_id",
        F.col("place_id").alias("ord"),
        "code",
        "name_en",
        F.col("name_alt").alias("name_ar"),
        F.array("alias", "category").alias("aliases"),
    )


NORM = "trim(regexp_replace(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

FIELDS_SQL = f"""prepared AS (SELECT query_id, lang, {NORM.format(c='text')} AS norm FROM queries),
fields AS (
  SELECT place_id, kind, {NORM.format(c='raw')} AS value FROM (
    SELECT place_id, 'code' AS kind, code AS raw FROM places UNION ALL SELECT place_id, 'en', name_en FROM places
    UNION ALL SELECT place_id, 'ar', name_alt FROM places UNION ALL SELECT place_id, 'alias', alias FROM places
    UNION ALL SELECT place_id, 'alias', category FROM places)),
toks AS (SELECT DISTINCT place_id, kind, unnest(string_split(value, ' ')) AS token FROM fields),
terms AS (SELECT query_id, lang, len(string_split(norm, ' ')) AS n_terms, unnest(generate_series(1, len(string_split(norm, ' ')))) AS term_ix,
  unnest(string_split(norm, ' ')) AS term FROM prepared WHERE norm <> ''),
vocab AS (SELECT DISTINCT token FROM toks),
asked AS (SELECT DISTINCT term FROM terms)"""

# Alignment distance row by row; a cell's left neighbour is folded in as a running minimum.
OSA_SQL = """near AS (SELECT term AS a, token AS z FROM asked, vocab WHERE length(term) >= 3 AND NOT regexp_matches(term, '[0-9]') AND NOT regexp_matches(token, '[0-9]')
  AND abs(length(term) - length(token)) <= CASE WHEN length(term) >= 6 THEN 2 ELSE 1 END),
dp(a, z, i, older, prev) AS (
  SELECT a, z, 0, CAST([] AS BIGINT[]), generate_series(0, length(z)) FROM near
  UNION ALL
  SELECT a, z, i + 1, prev, list_transform(generate_series(0, length(z)), lambda j: j + list_min(list_transform(generate_series(0, j), lambda k:
    CASE WHEN k = 0 THEN i + 1 ELSE least(prev[k + 1] + 1, prev[k] + CASE WHEN a[i + 1] = z[k] THEN 0 ELSE 1 END,
      CASE WHEN i >= 1 AND k >= 2 AND a[i + 1] = z[k - 1] AND a[i] = z[k] THEN older[k - 1] + 1 ELSE 99 END) END - k)))
  FROM dp WHERE i < length(a)),
osa AS (SELECT a AS term, z AS token, prev[length(z) + 1] AS distance FROM dp WHERE i = length(a)),
typos AS (SELECT * FROM osa WHERE distance <= CASE WHEN length(term) >= 6 THEN 2 ELSE 1 END),
scored AS (SELECT term, token, CASE WHEN term = token THEN 0 WHEN starts_with(token, term) THEN 3 ELSE 10 + distance END AS score
  FROM asked CROSS JOIN vocab LEFT JOIN typos USING (term, token) WHERE starts_with(token, term) OR distance IS NOT NULL)"""

WEIGHT = "CASE kind WHEN 'code' THEN 0 WHEN lang THEN 1 WHEN 'alias' THEN 3 ELSE 2 END"
SCORES_SQL = f"""by_terms AS (
  SELECT query_id, place_id, 40 + sum(best)::DOUBLE / n_terms AS score FROM
    (SELECT query_id, place_id, n_terms, term_ix, min(score + {WEIGHT}) AS best FROM terms JOIN scored USING (term) JOIN toks USING (token) GROUP BY ALL)
  GROUP BY query_id, place_id, n_terms HAVING count(*) = n_terms),
by_field AS (
  SELECT query_id, place_id, min(CAST(CASE WHEN value = norm THEN 5 WHEN starts_with(value, norm) THEN 20 ELSE 30 END + {WEIGHT} AS DOUBLE)) AS score
  FROM prepared JOIN fields ON norm <> '' AND contains(value, norm) AND (starts_with(value, norm) OR NOT regexp_matches(norm, '[0-9]'))
  GROUP BY query_id, place_id),
by_code AS (
  SELECT query_id, place_id, CASE WHEN replace(value, ' ', '') = replace(norm, ' ', '') THEN 0.0::DOUBLE ELSE 15.0::DOUBLE END AS score
  FROM prepared JOIN fields ON kind = 'code' AND norm <> '' AND starts_with(replace(value, ' ', ''), replace(norm, ' ', ''))),
listed AS (SELECT query_id, place_id, 0.0::DOUBLE AS score FROM prepared, places WHERE norm = ''),
hits AS (SELECT query_id, place_id, min(score) AS score FROM
  (SELECT * FROM by_terms UNION ALL SELECT * FROM by_field UNION ALL SELECT * FROM by_code UNION ALL SELECT * FROM listed) GROUP BY query_id, place_id)"""


def search_sql(body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([b.PLACES_SQL, QUERIES_SQL, FIELDS_SQL, OSA_SQL, SCORES_SQL]) + "\n" + body


def _parts(t):
    prepared = sized(se.prepare_queries(queries(t)))
    fields = sized(se.place_fields(places(t)))
    return prepared, fields, sized(se.place_tokens(fields)), se.query_terms(prepared)


def _scores(terms, toks):
    return se.token_scores(terms.select("term").distinct(), toks.select("token").distinct())


@query(
    "txt_normalize",
    f"""SELECT doc_id, md5({NORM.format(c='text')}) AS norm_hash FROM documents""",
)
def normalize(t):
    return t.documents.select("doc_id", F.md5(tx.normalize_search(F.col("text"))).alias("norm_hash"))


@query("txt_tokens", search_sql("SELECT place_id, kind, token FROM toks"))
def tokens(t):
    return se.place_tokens(se.place_fields(places(t))).select("place_id", "kind", "token")


@query("txt_osa_distance", search_sql("SELECT term, token, distance FROM typos"))
def osa_distance(t):
    _, _, toks, terms = _parts(t)
    return se.fuzzy_pairs(terms.select("term").distinct(), toks.select("token").distinct()).withColumn(
        "distance", F.col("distance").cast("long")
    )


@query("txt_token_score", search_sql("SELECT term, token, score FROM scored"))
def token_score(t):
    _, _, toks, terms = _parts(t)
    return _scores(terms, toks).withColumn("score", F.col("score").cast("long"))


@query("txt_field_score", search_sql("SELECT query_id, place_id, score FROM by_field"))
def field_score(t):
    prepared, fields, toks, terms = _parts(t)
    return se.field_scores(prepared, fields, toks, sized(_scores(terms, toks)))


@query("txt_compact_code", search_sql("SELECT query_id, place_id, score FROM by_code"))
def compact_code(t):
    prepared, fields = se.prepare_queries(queries(t)), se.place_fields(places(t))
    return se.compact_code_scores(prepared, fields)


@query("txt_all_terms", search_sql("SELECT query_id, place_id, round(score, 6) AS score FROM by_terms"))
def all_terms(t):
    _, _, toks, terms = _parts(t)
    return se.all_terms(terms, toks, sized(_scores(terms, toks))).withColumn("score", F.round("score", 6))


@query(
    "search_directory",
    search_sql(
        "SELECT query_id, place_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score, place_id) AS rank FROM hits"
    ),
)
def search_directory(t):
    return se.search(queries(t), places(t)).select("query_id", "place_id", F.round("score", 6).alias("score"), "rank")


@query(
    "top_search_rank",
    search_sql(
        """SELECT query_id, place_id, CAST(rank AS INTEGER) AS rank FROM
  (SELECT query_id, place_id, row_number() OVER (PARTITION BY query_id ORDER BY score, place_id) AS rank FROM hits) WHERE rank <= 10"""
    ),
)
def search_rank(t):
    return se.search(queries(t), places(t), k=10).select("query_id", "place_id", "rank")
