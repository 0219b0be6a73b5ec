import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from concourse.llm import infill
from tests.llm import brute


@pytest.mark.parametrize("kind", ["few", "scattered", "dense", "runs", "far"])
def test_select(kind):
    r = np.random.default_rng(3)
    places = {
        "few": np.array([0, 5, 70000, 70001, 1 << 33]),
        "scattered": np.flatnonzero(r.random(200_000) < 0.3),
        "dense": np.flatnonzero(r.random(200_000) < 0.9),
        "runs": np.concatenate([np.arange(10, 3000), np.arange(65_000, 140_000), [150_000]]),
        "far": np.unique(r.integers(0, 1 << 40, 5000)),
    }[kind]
    held = infill.Boundaries(places)
    assert held.size == len(places)
    for k in {0, 1, len(places) // 2, len(places) - 1, *r.integers(0, len(places), 200).tolist()}:
        assert held.select(k) == places[k]
    forms = {type(c).__name__ for c in held.containers}
    assert {"few": "ArrayContainer", "scattered": "BitmapContainer", "dense": "BitmapContainer", "runs": "RunContainer", "far": "ArrayContainer"}[kind] in forms


def expected(doc_id, text, layout):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{layout.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, whether, order = (int(digest[j : j + 8], 16) for j in (0, 8, 16, 24))
    marks = (layout.prefix, layout.suffix, layout.middle)
    if not text or whether % 100 >= layout.rewritten or any(m in text for m in marks):
        return len(units), "plain", None, None, text
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if order % 100 < layout.suffix_first:
        return len(units), "spm", len(prefix), len(middle), f"{layout.suffix}{suffix}{layout.prefix}{prefix}{layout.middle}{middle}"
    return len(units), "psm", len(prefix), len(middle), f"{layout.prefix}{prefix}{layout.suffix}{suffix}{layout.middle}{middle}"


@pytest.mark.parametrize("layout", [infill.Layout(), infill.Layout(rewritten=60, suffix_first=20, seed="x", prefix="[PRE]", suffix="[SUF]", middle="[MID]")])
def test_texts(spark, layout):
    rows = brute.corpus(60, seed=6) + [(1, "\n" * 200_000, "en", "s"), (2, "é\n" * 3000 + "end", "en", "s"), (3, "a <M> b\nc\n", "en", "s"), (4, "\n", "en", "s"), (5, "<\nP>\n<S\n>", "en", "s")]
    rows += [(i, "<P\n><\nS>" + "line\n" * (i % 7) + "<", "en", "s") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, held string").repartition(3)
    out = infill.transform(docs, layout)
    assert out.columns == ["doc_id", "text", "held", "n", "form", "prefix_chars", "middle_chars", "output"]
    seen = out.withColumn("back", infill.restored(F.col("output"), F.col("form"), layout)).collect()
    assert all(r["back"] == (r["text"] or "") for r in seen)
    got = sorted((str(r["doc_id"]), *map(str, (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]))) for r in seen)
    assert got == sorted((str(i), *map(str, expected(i, t, layout))) for i, t, *_ in rows)
    assert {r["form"] for r in seen} == {"plain", "psm", "spm"}
    assert infill.transform(docs.limit(0), layout).count() == 0
