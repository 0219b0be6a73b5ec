import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from concourse.llm import packing
from concourse.llm.tokens import END_ID, WordTokens, default_path
from tests.llm import brute

ODD = ["a <|endoftext|>b İst ΟΔΟΣ. é. x\xa0y z w don't. it's, \x1cfoo\x1dbar \x85q Á ,. !!. '. 's. x'. ǅ. '", "a\x00b \x1f x y", "n't. o'Re. <|startoftext|>. I'LL,. ſ. K. ! ? !", "", "中文。 ★"]


def test_words_give_the_ids_of_whole_texts():
    library, ours = Tokenizer.from_file(default_path()), WordTokens(default_path())
    texts = ODD + [r[1] or "" for r in brute.corpus(60)]
    ours.learn([t.encode() for t in texts[:20]])
    for text in texts:
        assert np.frombuffer(ours.ids(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_and_learned_again(monkeypatch):
    from concourse.llm import tokens

    monkeypatch.setattr(tokens, "MOST_WORDS", 60)
    library, ours = Tokenizer.from_file(default_path()), WordTokens(default_path())
    texts = [r[1] or "" for r in brute.corpus(40)]
    for at in range(0, len(texts), 5):
        ours.learn([t.encode() for t in texts[at : at + 5]])
        for text in texts[at : at + 5]:
            assert np.frombuffer(ours.ids(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_fill_is_the_closest():
    from itertools import product

    counts = {3: 2, 5: 3, 11: 1, 7: 2}
    for room in range(40):
        best = max(s for s in (sum(k * n for k, n in zip(counts, ns, strict=True)) for ns in product(*(range(v + 1) for v in counts.values()))) if s <= room)
        picked = packing.closest_fill(counts, room)
        assert sum(k * n for k, n in picked.items()) == best and all(n <= counts[k] for k, n in picked.items())


def test_pieces(spark):
    rows = brute.corpus(100)
    library = Tokenizer.from_file(default_path())
    window = 128
    got = packing.pack(spark.createDataFrame(rows, brute.DOCS).repartition(3), window=window).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, END_ID])
    for piece in got:
        assert any(
            len(x) == piece["doc_tokens"]
            and zlib.crc32(np.array(x[piece["start"] : piece["start"] + piece["length"]], "<u4").tobytes()) == piece["ids_crc32"]
            for x in ids[piece["doc_id"]]
        )
    total = sum(len(x) for of in ids.values() for x in of)
    assert sum(p["length"] for p in got) == total
    sequences = defaultdict(list)
    for p in got:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert len(sequences) <= -(-total // window) + 2
    assert packing.pack(spark.createDataFrame([], brute.DOCS)).count() == 0
