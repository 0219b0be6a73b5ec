import numpy as np
import pytest

from concourse.llm import periodic
from tests.llm import brute


def runs_of(words, least=12):
    """All runs, by walking every diagonal."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(rows, least=12):
    ranks, longest = np.concatenate([np.asarray(r) + 1000 * k for k, r in enumerate(rows)]), max(map(len, rows))
    _, ranks = np.unique(ranks, return_inverse=True)
    start, length, period = periodic.find_runs(ranks.astype(np.int32), longest, least)
    want, at = [], 0
    for r in rows:
        want += [(at + a, n, q) for a, n, q in runs_of(list(r), least)]
        at += len(r)
    assert sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[2])) == sorted(want, key=lambda r: (r[0], r[2]))
    return len(want)


@pytest.mark.parametrize("least", [2, 5, 8, 12, 13])
def test_random_rows(least):
    r = np.random.default_rng(least)
    found = 0
    for _ in range(60):
        rows = []
        for _ in range(int(r.integers(1, 5))):
            row = list(r.integers(0, int(r.integers(1, 5)), int(r.integers(0, 70))))
            if r.random() < 0.6:
                q = int(r.integers(1, 30))
                row += list(r.integers(0, 40, q)) * int(r.integers(1, 5)) + list(r.integers(0, 40, 5))
            rows.append(row)
        if max(map(len, rows)):
            found += check(rows, least)
    assert found > 50


def test_known_rows():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    check([b])  # a Fibonacci word: runs of every size
    thue = [bin(i).count("1") % 2 for i in range(512)]
    check([thue])
    check([[7] * 400, [7] * 11, [7] * 12, [1, 2] * 6, [1, 2] * 5, [], [3]])
    assert check([list(range(50)) * 2]) == 1 and check([list(range(50)) * 2 + [0]]) == 1 and check([list(range(50)) * 2][:1]) == 1


def test_time_follows_the_words():
    ranks = np.zeros(1_000_000, dtype=np.int32)
    start, length, period = periodic.find_runs(ranks, len(ranks))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [1_000_000], [1])


def test_texts(spark):
    rows = brute.corpus(60, seed=4) + [(1, "ha " * 40 + "end", "en", "s"), (1, "ha " * 40 + "end", "en", "s"), (2, "a b c d e\n" * 9, "en", "s"), (3, "Ha ha " * 3, None, None)]
    rows += [(4, " ".join(str(i) for i in range(3000)) + " " + " ".join(str(i) for i in range(3000)), "en", "s"), (5, " x " * 20, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, N_words string").repartition(3)
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = sorted((str(r["doc_id"]), r["text"] or "", r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect())
    want = []
    for doc_id, text, *_ in rows:
        words = brute.WORD.findall(text or "")
        found = sorted(runs_of(words), key=lambda r: (r[0], r[2])) if doc_id != 4 else [(0, 6000, 3000)]
        want.append((str(doc_id), text or "", len(words), found, collapsed(words, found)))
    assert got == sorted(want)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
