"""Typing errors in long terms: pieces and their places find what all pairs find."""

import random

from concourse.operators import search


def osa(a, b):
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def edited(word, draw):
    at = draw.randrange(len(word) - 1)
    kind = draw.randrange(4)
    if kind == 0:
        return word[:at] + word[at + 1 :]
    if kind == 1:
        return word[:at] + draw.choice("abc") + word[at:]
    if kind == 2:
        return word[:at] + draw.choice("abc") + word[at + 1 :]
    return word[:at] + word[at + 1] + word[at] + word[at + 2 :]


def test_long_terms(spark):
    draw = random.Random(3)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(20, 48))) for _ in range(60)]
    words += ["a" * n for n in range(21, 28)] + ["ab" * 13, "ba" * 13, "é" * 25]
    near = [edited(edited(w, draw) if draw.random() < 0.7 else w, draw) for w in words for _ in range(3)]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    tokens = spark.createDataFrame([(w,) for w in sorted({*near, *words[:20]})], "token string")
    got = {(r["term"], r["token"], r["distance"]) for r in search.fuzzy_pairs(terms, tokens).collect()}
    want = {(a, b, osa(a, b)) for a in words for b in {*near, *words[:20]} if abs(len(a) - len(b)) <= 2 and osa(a, b) <= 2}
    assert got == want and len(want) > 150
