"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from concourse.llm import chat
from concourse.llm.queries import PROBE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN both_ways ON y = a)
SELECT n.doc_id, n.n AS n_shingles, min(y) AS component_id FROM n JOIN reach ON x = n.doc_id GROUP BY 1, 2"""

_BUDGET = chat.Budget()
_RESTS = "|".join(c[1:].replace("|", "\\|").replace("]", "\\]") for c in chat.CONTROLS)
_MARKS = len(chat.OPEN + chat.SEP + chat.CLOSE)
_PROBE = PROBE.replace("'", "''")


def _escaped(column: str) -> str:
    """Length of a text with its escapes."""
    return f"(length({column}) + length({column}) - length(replace({column}, '\\', '')) + len(regexp_extract_all({column}, '[<\\[](?:{_RESTS})')))"


CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'),
t AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')) + 3 AS k,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS o FROM c),
p AS (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY o) - k AS bef, first_value(role) OVER q AS r0, first_value(text) OVER q AS t0, first_value(k) OVER q AS k0
  FROM t WINDOW q AS (PARTITION BY conv_id ORDER BY o)),
m AS (SELECT *, r0 = '{chat.SYSTEM}' AND k0 <= {_BUDGET.window // 2} AS sys FROM p),
r AS (SELECT *, greatest({_BUDGET.window - _BUDGET.history} - CASE WHEN sys THEN k0 ELSE 0 END, 1) AS room, {_escaped("role")} + {_escaped("text")} + {_MARKS} AS chars FROM m),
f AS (SELECT *, bef // room AS stride FROM r),
g AS (SELECT *, 2 * stride + CASE WHEN bef + k > (stride + 1) * room THEN 1 ELSE 0 END AS win FROM f),
v AS (SELECT conv_id, win, min(bef) AS opens, min(o) AS first_o, sum(chars) AS chars, any_value(sys) AS sys,
  any_value({len(chat.SYSTEM) + _MARKS} + {_escaped("t0")}) AS system_chars FROM g GROUP BY 1, 2),
h AS (SELECT v.conv_id, v.win, sum(g.chars) AS past FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.win < v.win AND v.opens - g.bef <= {_BUDGET.history}
  AND g.k <= {_BUDGET.history} AND (NOT g.sys OR g.o > 0) GROUP BY 1, 2),
z AS (SELECT v.conv_id, sum(chars + coalesce(past, 0) + CASE WHEN sys AND first_o > 0 AND v.win > 0 THEN system_chars ELSE 0 END) AS formatted_chars
  FROM v LEFT JOIN h ON v.conv_id IS NOT DISTINCT FROM h.conv_id AND v.win = h.win GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY o)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{chat.TARGET}'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY o) FILTER (role = '{chat.TARGET}'), '')) AS loss_sha256
  FROM t GROUP BY 1)
SELECT d.conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM d JOIN z ON d.conv_id IS NOT DISTINCT FROM z.conv_id"""

# Bit by bit CRC-32 of the decimal doc_id.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: unicode(substr(CAST(doc_id AS VARCHAR), i, 1))::UBIGINT)),
  lambda c, x: list_reduce(list_concat([xor(c, x)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))), 4294967295::UBIGINT)"""

PERIODIC = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {_CRC} AS h FROM documents),
p AS (SELECT doc_id, ws, h, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, 3 + (h // 10) % 8 AS k FROM d),
q AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1 AS BIGINT)]) ELSE ws END AS ws FROM p),
w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word FROM q),
-- A run of 12 words or more agrees with itself over 6 at least: all pairs of equal six-grams of a text, as diagonals.
g AS (SELECT doc_id, i, hash(word, lead(word, 1) OVER s, lead(word, 2) OVER s, lead(word, 3) OVER s, lead(word, 4) OVER s, lead(word, 5) OVER s) AS x, lead(word, 5) OVER s AS l FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT a.doc_id, a.i, b.i - a.i AS lag FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i WHERE a.l IS NOT NULL AND b.l IS NOT NULL),
o AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM m),
c AS (SELECT doc_id, lag, min(i) AS start, max(i) + 6 + lag - min(i) AS length FROM o GROUP BY doc_id, lag, island),
r AS (SELECT doc_id, start, length, min(lag) AS period FROM c WHERE length >= greatest(12, 2 * lag) GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_runs, max((length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY 1),
e AS (SELECT doc_id, i, sum(step) AS step FROM (SELECT doc_id, start + period AS i, 1 AS step FROM r UNION ALL SELECT doc_id, start + length, -1 FROM r) GROUP BY 1, 2),
v AS (SELECT w.doc_id, w.i, word, sum(coalesce(step, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS depth FROM w LEFT JOIN e ON e.doc_id = w.doc_id AND e.i = w.i),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM v WHERE depth = 0 GROUP BY 1)
SELECT q.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-best[2] AS BIGINT) AS start, CAST(best[1] AS BIGINT) AS length, CAST(-best[3] AS BIGINT) AS period,
  CAST(1000 * best[1] // -best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM q LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""

INFILL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT x, b FROM reach JOIN link ON y = a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON x = vec_id LEFT JOIN n ON a = vec_id"""

SQL = {
    "op1_chat_formatting": CHAT,
    "op2_ngram_jaccard": JACCARD,
    "op11_periodic_runs": PERIODIC,
    "op12_fill_in_middle": INFILL,
    "op13_embedding_near_dedup": VECTORS,
}
