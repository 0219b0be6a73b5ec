"""Quality rules, line dedup, decontamination and the classifier."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from concourse.llm import classifier, decontaminate, line_dedup, quality_rules
from concourse.llm.kernels import chunks
from tests.llm import brute


def measures(text):
    words = brute.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rows = brute.corpus(100) + [(3000, "á é\n\ná é\r\na\x0bb | < > a b c a b c", "en", "x")]
    got = quality_rules.measured(spark.createDataFrame(rows, brute.DOCS).withColumn("n_words", F.lit("clash"))).collect()
    want = sorted((str(r[0]), *measures(r[1])) for r in rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["outside"])


def test_quality_follows_the_group(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    clean = [(i, " ".join(word() for _ in range(80)), "en", "plain") for i in range(250)]
    marked = [(1000 + i, " ".join(word() + "#" * (j % 3 == 0) for j in range(80)), "en", "code") for i in range(250)]
    junk = [(5000 + i, " ".join(word() + "$$$" for _ in range(80)), "en", "plain") for i in range(5)]
    docs = spark.createDataFrame(clean + marked + junk, brute.DOCS)
    got = quality_rules.with_quality(docs.withColumn("kept", F.lit(1))).collect()
    kept = {row["doc_id"]: row["kept"] for row in got}
    assert all(kept[i] for i, *_ in clean + marked) and not any(kept[i] for i, *_ in junk)
    assert quality_rules.measured(docs.limit(0)).count() == 0


def kept_lines(rows):
    """Line dedup with plain strings; the chunk borders come from the operator."""
    import pyarrow as pa

    first, out = {}, []
    cut = []
    for doc_id, text in rows:
        chunk = next(chunks(pa.array([text], pa.string())))
        found = line_dedup.line_chunks(chunk)
        raw = (text or "").encode()
        cut.append([(f, n, raw[s : s + b]) for f, n, s, b in zip(*(found[k].tolist() for k in ("first", "lines", "start", "bytes")), strict=True)])
    for (doc_id, text), spans in zip(rows, cut, strict=True):
        for f, _, body in spans:
            key = (doc_id is not None, doc_id or 0, text or "", f)
            first[body] = min(first.get(body, key), key)
    for (doc_id, text), spans in zip(rows, cut, strict=True):
        lines = (text or "").split("\n")
        gone = {f + i for f, n, body in spans if first[body] != (doc_id is not None, doc_id or 0, text or "", f) for i in range(n)}
        out.append((str(doc_id), len(lines), len(gone), hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    rows = [(r[0], r[1]) for r in brute.corpus(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("version", F.lit(3))
    got = line_dedup.removed_lines(docs).collect()
    want = kept_lines(rows)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_removed_lines"], r["kept_sha256"]) for r in got) == want
    assert sum(1 for w in want if w[2]) > 10
    whole = line_dedup.dedup_lines(docs)
    assert whole.columns == ["doc_id", "text", "version", "n_lines", "n_removed_lines", "n_removed_chunks"]
    assert whole.filter("version = 3").count() == len(rows)
    assert line_dedup.removed_lines(docs.limit(0)).count() == 0


def lines_of_repeated_runs(rows):
    """Per document the lines in any run of two lines and 40 filled bytes or more that an earlier place holds too; by trying all runs."""
    first, runs = {}, []
    for doc_id, text in rows:
        lines, own = text.split("\n"), []
        for i in range(len(lines)):
            for k in range(i + 1, len(lines)):
                body = "\n".join(lines[i : k + 1])
                if len("".join(body.split()).encode()) >= 40:
                    own.append((i, k, body))
                    first[body] = min(first.get(body, (doc_id, i)), (doc_id, i))
        runs.append(own)
    return {d: {x for i, k, body in own if first[body] != (d, i) for x in range(i, k + 1)} for (d, _), own in zip(rows, runs, strict=True)}


def test_line_dedup_finds_every_repeated_run(spark):
    r = random.Random(12)
    serial = iter(range(10**6))
    line = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k)) + f" {next(serial)}"
    passages = [[line(r.randint(12, 30)) for _ in range(2 + i % 7)] for i in range(30)]
    passages += [["{", "x", "", "y = 1;", "}", "b" * 34, "c", ""], ["a" * 39, "b", "c", "d"], ["d", "c", "b", "e" * 39], ["q"] * 45]
    rows, planted, alone = [], [], line(20)
    for copy in range(3):
        for i, passage in enumerate(passages):
            head, tail = ([line(9) for _ in range(r.randint(1, 4))] for _ in range(2))
            rows.append((1000 * copy + i, "\n".join([*head, *passage, *tail])))
            planted += [(1000 * copy + i, len(head), len(passage))] * (copy > 0)
    rows += [(5000 + i, "\n".join([line(9), alone, line(9)])) for i in range(3)]
    rows += [(6000, "\n".join([line(9), *passages[5], line(9), *passages[5], line(9)])), (6001, "z z\n" + "\n" * 300 + line(30)), (6002, "")]
    rows.append((6003, rows[-2][1]))
    gone = lines_of_repeated_runs(rows)
    assert all(set(range(at, at + n)) <= gone[d] for d, at, n in planted) and not any(gone[5000 + i] for i in range(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs).collect()}
    for doc_id, text in rows:
        assert got[doc_id]["text"] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc_id]), doc_id
        assert got[doc_id]["n_removed_lines"] == len(gone[doc_id])
        assert got[doc_id]["n_removed_chunks"] == len([i for i in gone[doc_id] if i + 1 not in gone[doc_id]])


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


def test_decontamination(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20)).capitalize()) for i in range(12)] + [(50, None), (51, ""), (52, items_text := "short one")]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(60))
        if i % 2:
            leak = list(items[i % 12][1])
            for _ in range(i % 9):
                at = r.randrange(len(leak))
                leak[at : at + 1] = r.choice([["x"], [], ["q", leak[at]]])
            text = text[:50] + "".join(leak).replace(" ", "\n ", 1) + text[50:]
        docs.append((i, text))
    docs += [(None, items[0][1]), (90, None), (91, ""), (92, items_text), (92, items_text)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(h["doc_id"]), h["item_id"], h["distance"]) for h in decontaminate.matches(table, benchmark).collect())
    want = []
    for doc_id, text in docs:
        for item_id, item in items:
            item, whole = decontaminate.normal(item), decontaminate.normal(text)
            if item and (d := least_distance(item, whole)) <= len(item) // decontaminate.LENGTH_PER_EDIT:
                want.append((str(doc_id), item_id, d))
    assert got == sorted(want) and len(got) > 20
    hit = {w[0] for w in want}
    assert sorted(str(x["doc_id"]) for x in decontaminate.without_matches(table, benchmark).collect()) == sorted(str(d) for d, _ in docs if str(d) not in hit)
    assert decontaminate.matches(table, benchmark.limit(0)).count() == 0
    assert decontaminate.matches(table.limit(0), benchmark).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)
    items = [(i, f"item number {i} of the small benchmark") for i in range(5)]
    docs = spark.createDataFrame([(1, "so: item number 3 of the small benchmark!"), (2, "nothing")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {h["doc_id"] for h in decontaminate.matches(docs, benchmark).collect()} == {1}
    assert [d["doc_id"] for d in decontaminate.without_matches(docs, benchmark).collect()] == [2]


def test_gradients():
    model, r = classifier.Model.start(), np.random.default_rng(3)
    for p in model.parts():
        p[...] = r.standard_normal(p.shape) * 0.3
    x, first, y = r.random((7, classifier.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    parts = [p.astype(np.float64) for p in model.parts()]
    model = classifier.Model(*parts)
    for p, g in zip(model.parts(), model.slopes(x, first, y), strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-5
        p[at] += 1e-6


def test_classifier_held_out(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(600):
        good = r.random() < 0.6
        parts = [" ".join(word() for _ in range(60)) for _ in range(r.randint(1, 4))]
        if not good:
            parts[r.randrange(len(parts))] = " ".join(word().upper() + "!!" for _ in range(60))
        docs.append((i, "\n".join(parts), "en", "s"))
        labels.append((i, int(good), 0))
    docs += [(None, "text", None, None), (900, None, None, None), (901, "", None, None), (0, docs[0][1], "en", "s")]
    labels += [(5000, 1, 0), (3, None, 0), (None, 1, 0)]
    table = spark.createDataFrame(docs, brute.DOCS)
    got = classifier.classify(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got)
    truth = {i: q for i, q, _ in labels if i is not None and i < 600 and i != 3}
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert len(held) > 100 and np.mean([g["predicted"] == truth[g["doc_id"]] for g in held]) > 0.9
    none = classifier.classify(table, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {g["score"] for g in none} == {0.5}


def test_training_rows_are_chosen_by_size(spark, monkeypatch):
    rows = [(i, "word " * (10 + i)) for i in range(0, 90)] + [(90, "long " * 5000), (91, "long " * 5000), (3, "a second text"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(92)], "doc_id long, quality int, toxic int")
    everything, y = classifier.sample(docs, labels)
    monkeypatch.setattr(classifier, "MOST_BYTES", 4000)
    few, z = classifier.sample(docs, labels)
    assert 0 < len(few) == len(z) < len(everything) == len(y)
    assert max(len(b) for b in few) <= 8 < max(len(b) for b in everything)
    monkeypatch.setattr(classifier, "MOST_BYTES", -1)
    assert classifier.sample(docs, labels)[0] == []


def test_memory_of_counts_follows_the_chunk_and_not_the_batch():
    texts = pa.array([" ".join(f"w{i * j % 977}" for j in range(400)) for i in range(6000)])
    tracemalloc.start()
    counted = sum(int(quality_rules.count_measures(chunk)["n_words"].sum()) for chunk in chunks(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted == 6000 * 400
    assert peak < 80 << 20
