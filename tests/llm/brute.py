"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))}


def components(nodes: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    up = {n: n for n in nodes}

    def root(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def similar(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component) for distinct ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    ids = sorted(sets, key=lambda i: len(sets[i]))
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if not sets[a] or 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                links.append((a, b))
    label = components(list(sets), links)
    return {i: (len(sets[i]), label[i]) for i in sets}


def repeated_bytes(texts: list[bytes], length: int = 400) -> list[list[tuple[int, int]]]:
    """Maximal runs of the bytes that a string of ``length`` bytes found twice or more covers, per text."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            key = t[i : i + length]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for t in texts:
        runs: list[tuple[int, int]] = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], i + length)
                else:
                    runs.append((i, i + length))
        out.append(runs)
    return out


def corpus(n: int = 120, seed: int = 5) -> list[tuple[int | None, str | None, str | None, str | None]]:
    """doc_id, text, lang, source: prose with exact and near copies, shared passages, junk, nulls and empty texts."""
    import random

    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["the", "an", "er", "ti", "on", "é", "ü", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + "."
    shared = ["\n".join(line(r.randint(9, 14)) for _ in range(6)) for _ in range(3)]
    rows: list[tuple[int | None, str | None, str | None, str | None]] = []
    for i in range(n):
        text = "\n".join(line(r.randint(6, 16)) for _ in range(r.randint(1, 25)))
        if i % 5 == 1 and len(text) > 40:
            text = text[: len(text) // 2] + "\n" + r.choice(shared) + "\n" + text[len(text) // 2 :]
        if i % 6 == 2 and rows:
            text = r.choice(rows)[1] or ""
        if i % 6 == 3 and rows:
            words = (r.choice(rows)[1] or "x").split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        if i % 17 == 4:
            text = " ".join(f"{r.choice(vocabulary)}***" for _ in range(90))
        rows.append((i * 3, text, ("en", "fr", None)[i % 3], ("src0", "src1")[i % 2]))
    rows += [(1000, None, None, None), (1001, "", "en", None), (1002, " \n\t ", "en", "src0"), (1003, "one two", "en", "src0"), (1004, "ONE two", "en", "src0")]
    rows += [(1005, "x" * 3000, "en", "src0"), (1006, "a b " * 700, "en", "src0"), (1006, "a b " * 700, "en", "src0"), (None, rows[0][1], "en", "src0")]
    return rows


DOCS = "doc_id long, text string, lang string, source string"
