import hashlib

import pytest

from concourse.llm import suffixes
from tests.llm import brute


def expected(texts):
    out = []
    for text, runs in zip(texts, brute.repeated_bytes(texts), strict=True):
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 0])
def test_against_brute_force(spark, hot):
    rows = brute.corpus(90, seed=8)
    passage = "shared words " * 3 + "".join(chr(97 + (i * i) % 23) for i in range(420))
    rows += [(2000 + i, f"start {i} " + passage[i % 5 : 400 + i % 7] + f" end {i}", "en", "src0") for i in range(12)]
    got = suffixes.dedup(spark.createDataFrame(rows, brute.DOCS), hot).collect()
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted((str(r[0]), *e) for r, e in zip(rows, expected(texts), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert sum(1 for w in want if w[2]) > 15


def test_length_is_exact(spark):
    a, b = bytes((i * i * 7 + i) % 26 + 97 for i in range(400)).decode(), "Q" * 3
    rows = [(1, b + a + "x"), (2, "yy" + a + "z"), (3, a[:399] + "!"), (4, a[1:] + "?")]
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 400, 2: 400, 3: 0, 4: 0}


def test_empty_table(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
