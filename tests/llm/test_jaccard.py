from pyspark.sql import functions as F

from concourse.llm import jaccard
from concourse.llm.components import components
from tests.llm import brute


def test_against_brute_force(spark):
    rows = [r for r in brute.corpus(150) if r[0] is not None]
    got = jaccard.similar(spark.createDataFrame(rows, brute.DOCS).withColumn("size", F.lit("clash"))).collect()
    want = brute.similar([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert sum(1 for i, (_, label) in want.items() if label != i) > 20


def test_long_lists_and_split_lists(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        words[(i * 7) % 120] = f"x{i}"
        words[(i * 13 + 5) % 120] = f"y{i % 9}"
        rows.append((i, " ".join(words if i % 3 else words[:80] + [f"z{i}{j}" for j in range(20 + i)])))
    for grade, heavy in ((12, 32), (2, 2), (12, 1000)):
        monkeypatch.setattr(jaccard, "SPLIT_GRADE", grade)
        monkeypatch.setattr(jaccard, "HEAVY", heavy)
        monkeypatch.setattr(jaccard, "PART", 8)
        monkeypatch.setattr(jaccard, "FREQUENT", 2)
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs).collect()}
        assert got == brute.similar(rows)


def test_threshold_is_exact(spark):
    # 8 of 10 shingles shared is a link, 7 of 10 is none.
    a = "a b c d e f g h i j k l m"
    rows = [(1, a), (2, a.replace("m", "m n")), (3, "a b c d e f g h i j k l q"), (4, "a b c d e f g h i j p q r"), (9, "A b c d e f g h i j k l m")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.similar(rows).items()}


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "other words than that one here"), (7, "other words than that one here"), (8, None)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(
        [(None, 2, None), (5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 0, 8)], key=str
    )
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40, 1) if i != 20] + [(50, 70), (70, 60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    nodes = sorted({n for link in chain for n in link})
    assert got == brute.components(nodes, chain)
