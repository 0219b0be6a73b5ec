"""Chat windows, url filters and token files."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concourse.llm import arrow_output, chat, url_filter
from concourse.llm.queries import PROBE, RULES
from concourse.llm.tokens import END_ID, default_path
from tests.llm import brute

TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    r = random.Random(2)
    odd = ["<|im_end|>", "\\", "<s>", "[INST]x", "\\<|im_sep|>", "<", "[", "é\n", "<<SYS>>", PROBE, "\\\\<s>", ""]
    rows = []
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, 0, "system", "rules " * r.randint(1, 40 if c else 400)))
        for t in range(1, r.randint(2, 30)):
            text = " ".join(r.choice(["word", "é", *odd]) for _ in range(r.randint(0, 90)))
            rows.append((c, t, ("assistant", "user")[t % 2], text))
    rows += [(90, None, "user", "early"), (90, 1, None, None), (90, 1, "assistant", "a"), (90, 1, "assistant", "a"), (None, 3, "assistant", "no id"), (-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    rows += [(95, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(2500)]
    return rows


def digest(rows):
    want = {}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        whole = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        want[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return want


@pytest.mark.parametrize("budget", [chat.Budget(), chat.Budget(200, 40), chat.Budget(64, 60)])
def test_round_trip(spark, budget):
    rows = conversations()
    random.Random(1).shuffle(rows)
    made = chat.windows(spark.createDataFrame(rows, TURNS).withColumn("window", F.lit("clash")), budget).cache()
    got = {r[0]: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert got == digest(rows)
    systems = {r[0] for r in rows if r[2] == "system"}
    for w in made.collect():
        body = re.split(re.escape(chat.CLOSE), w["formatted"])[:-1]
        assert len(body) == w["n_turns"] + w["repeated"]
        assert all(b.count(chat.OPEN) == 1 and b.count(chat.SEP) == 1 for b in body)
        for b in body:
            text = b.split(chat.SEP)[1]
            assert not any(c in text for c in chat.CONTROLS)
        if w["tokens"] > budget.window:
            assert w["n_turns"] == 1
        if w["window"] > 0 and w["conv_id"] in systems and w["repeated"]:
            assert w["conv_id"] == 0 or body[0].startswith(chat.OPEN + "system") or w["conv_id"] not in systems or budget.window <= 200
    assert made.filter("repeated > 0").count() > 5
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]


def rule_of(host, path):
    fits = []
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), rule, verdict))
    return min(fits)[1:] if fits else (None, None)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net", "http://a.net?x", "http://a.net/", "https://example.net/en/5", "https://m.example.net/en/", "http://example.net/de/", "http://example.com/de/x#y", "http://a.example.com/de", "http://ÄB.org/fr/1", "http://xorg/fr/", "a://b://c.net/z", "http://example.net:80/en/", "http://.net/", "http://h.org/fr/\nx?y", "http://net/", "http://www.free-bets.example.com/en/9", "http://library.example.com/en/9"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    judged = url_filter.judge(pages, url_filter.rule_rows(spark, RULES), url_filter.labelled_urls(spark)).collect()
    assert len(judged) == len(urls) + 1
    for r in judged:
        host, path = parts(urls[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    by_id = {r["page_id"]: r for r in judged}
    assert by_id[19]["verdict"] == "block" and by_id[20]["verdict"] == "allow"
    empty = url_filter.judge(pages.limit(0), url_filter.rule_rows(spark, RULES), url_filter.labelled_urls(spark).limit(0))
    assert empty.count() == 0


def test_url_model_separates_unseen_paths(spark):
    sites = [(f"https://{p}{s}.example.{e}/en/{n}", int(s in url_filter.BLOCKED_SITES)) for s in url_filter.BLOCKED_SITES + url_filter.ALLOWED_SITES for p in ("", "shop.") for e in ("com", "org") for n in (77, 3120)]
    sites += [(f"https://{x}.example.net/fr/{n}", 0) for x in ("ththin", "tionsh", "m.thertion", "blog.ththre") for n in (5, 61)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(sites)], "page_id long, url string")
    got = url_filter.judge(pages, url_filter.rule_rows(spark, [("block", "nowhere/")]), url_filter.labelled_urls(spark)).collect()
    assert all((r["verdict"] == "block") == bool(sites[r["page_id"]][1]) for r in got)


def test_token_files(spark, tmp_path):
    rows = brute.corpus(80)
    docs = spark.createDataFrame(rows, brute.DOCS).repartition(4).withColumn("shard", F.lit("clash"))
    folder = str(tmp_path / "tokens")
    manifest = arrow_output.write_sequences(docs, folder, sequence=64)
    library = Tokenizer.from_file(default_path())
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, END_ID] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    want, start = [], 0
    for i in order:
        want.append((rows[i][0], start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    got = sorted((tuple(r) for r in arrow_output.read_documents(manifest).collect()), key=lambda r: r[1])
    assert got == want
    stream = []
    for row in sorted(manifest.collect()):
        shard = arrow_output.SequenceFile(row["path"])
        assert len(shard) == row["sequences"]
        for i in range(len(shard)):
            sequence, mask = shard.sequence(i)
            assert len(sequence) == 64 and not sequence.flags.owndata and not sequence.flags.writeable
            stream += sequence[: mask.true_count].tolist()
        with pytest.raises(IndexError):
            shard.sequence(len(shard))
    assert stream == [x for i in order for x in ids[i]]
    assert not list((tmp_path / "tokens").glob(".draft*"))
    empty = arrow_output.write_sequences(docs.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0 and arrow_output.read_documents(empty).count() == 0
