import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concourse.llm import decontaminate, quality_rules
from concourse.llm.tables import table
from tests.llm import brute
from tests.llm.test_texts import kept_lines, measures

ITEM = "the exam asks how many stones lie on the third shelf of the old museum in the north of town"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [r for r in brute.corpus(160, seed=3) if r[0] is not None and r[0] < 1000]
    clean = [(2000 + i, r[1] + " " + " ".join(f"extra{i}x{j}" for j in range(60)), "en", "src0") for i, r in enumerate(rows[:30])]
    leaks = [(3000 + i, f"{clean[i][1]} {ITEM} {i}", "en", "src0") for i in range(3)]
    # Near copies that differ within their one line, so that line dedup leaves them to the join.
    near = [(5000 + 10 * i + k, " ".join(f"near{i}x{j}" if j != 40 * k else f"own{k}" for j in range(120)), "en", "src0") for i in range(6) for k in range(3)]
    rows = [(*r, len(r[1] or "")) for r in rows + clean + leaks + near + [(4000, None, "en", "src0")]]
    spark.createDataFrame(rows, brute.DOCS + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    named = dict(corpus_pipeline.STAGES)
    before = docs.collect()
    kept = named["quality rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.measured(docs).collect()}
    first = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert first == {r["doc_id"]: r["text"] for r in before if verdicts[r["doc_id"]]}
    for r in before:
        words, _, _, _, repeated = measures(r["text"])
        if words < 50 or 100 * repeated > 50 * words:
            assert r["doc_id"] not in first
    lines = named["line dedup"](spark, kept, folder)
    second = {r["doc_id"]: r["text"] for r in lines.collect()}
    import hashlib

    want = {int(i): d for i, _, _, d in kept_lines(sorted(first.items()))}
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in second.items()} == want
    near = named["n-gram Jaccard join"](spark, lines, folder)
    third = {r["doc_id"]: r["text"] for r in near.collect()}
    labels = brute.similar(sorted(second.items()))
    assert third == {i: t for i, t in second.items() if labels[i][1] == i}
    clean = named["benchmark decontamination"](spark, near, folder)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in third.items() if decontaminate.normal(ITEM) not in decontaminate.normal(t)}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}
    assert len(third) < len(second) < len(before)
    assert sum(1 for i in second if i >= 5000) - sum(1 for i in third if i >= 5000) >= 6


def test_clashing_columns_and_empty_table(spark, folder):
    docs = table(spark, folder, "documents")
    names = ["n_words", "kept", "_lang", "_fence", "n_lines", "version", "rest", "_nth", "part"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns
        for r in out.limit(5).collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates_with_clashing_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [
        (1, text("a")), (1, text("b")), (1, text("c")), (1, text("c")),  # three texts under one id, one of them twice
        (2, text("b") + " end"), (3, text("d")), (4, text("d") + " end"), (5, ""), (5, text("e")), (5, None),
        (7, text("f")), (8, text("f") + " end"), (8, text("g")), (6, text("g") + " end"), (None, text("h")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit("k"), "_version": F.lit("v")}).repartition(4)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), str(r["text"]), r["_key"], r["_version"]) for r in out.collect())
    gone = [(1, text("c")), (2, text("b") + " end"), (4, text("d") + " end"), (8, text("f") + " end"), (8, text("g"))]
    want = list(rows)
    for row in gone:
        want.remove(row)
    assert got == sorted((str(i), str(t), "k", "v") for i, t in want)
