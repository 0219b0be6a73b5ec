"""Token ids of whole texts with the ``tokenizers`` library, one look-up per word.

The vocabulary of ``word_bpe_49k.json`` drops white space and never joins across it, so a text's ids are its words'
ids in order.  Each task keeps the ids of the words it has met and asks the library for new ones only; the memory
for that is bounded by ``MOST_WORDS``.
"""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

END_ID = 1
SEPARATOR = "!"
MARKS = b".,;:!?%$#&*|"
MOST_WORDS = 600_000
_LOADED: dict[str, "WordTokens"] = {}


class WordTokens:
    """``ids(text)``: little-endian 16-bit ids of a text given as UTF-8 bytes, without the end id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.bar = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        if len(self.bar) != 1 or sys.byteorder != "little":
            raise ValueError("the separating mark is not one token, or ids are not little-endian here")
        self.known: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> None:
        """Ids of distinct words: many words a call, told apart by the id of a mark that none of them holds."""
        model = self.library.model
        for word in words:
            if word.isalpha():  # ASCII letters only, lower-cased before: the normaliser and the splitter leave it alone
                self.known[word] = array("H", [x.id for x in model.tokenize(word.decode())]).tobytes()
        words = [w for w in words if not w.isalpha()]
        plain = [w for w in words if SEPARATOR.encode() not in w]
        runs = [plain[i : i + 4096] for i in range(0, len(plain), 4096)]
        joined = [f" {SEPARATOR} ".join(w.decode("utf-8", "replace") for w in run) for run in runs]
        for run, found in zip(runs, self.library.encode_batch(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u2")
            cuts = np.flatnonzero(ids == self.bar[0])
            raw, ends = ids.tobytes(), (2 * cuts).tolist() + [2 * len(ids)]
            if len(ends) != len(run):
                raise ValueError("words and ids do not line up")
            start = 0
            for word, end in zip(run, ends, strict=True):
                self.known[word] = raw[start:end]
                start = end + 2
        for word in words:
            if SEPARATOR.encode() in word:
                found = self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False)
                self.known[word] = np.array(found.ids, dtype="<u2").tobytes()

    def _learn(self, fresh: list[bytes]) -> None:
        known = self.known
        if len(known) + 2 * len(fresh) > MOST_WORDS:
            known.clear()
        # A run of letters and the marks after it never share a token; ASCII lower-casing is the library's own.
        cores = [w.lower().rstrip(MARKS) if w.isascii() else w.rstrip(MARKS) for w in fresh]
        for i, (word, core) in enumerate(zip(fresh, cores, strict=True)):
            if len(core) != len(word) and not (core[-1:].isalpha() or core and core.decode("utf-8", "replace")[-1].isalpha()):
                cores[i] = word.lower() if word.isascii() else word
        tails = {w[len(c) :] for w, c in zip(fresh, cores, strict=True)}
        self._encode([w for w in {*cores, *tails} if w not in known])
        for word, core in zip(fresh, cores, strict=True):
            known[word] = known[core] + known[word[len(core) :]]

    def learn(self, texts: list[bytes]) -> None:
        """Ask the library once for all new words of some texts."""
        fresh = set(b" ".join(texts).split()).difference(self.known)
        if fresh:
            self._learn(list(fresh))

    def ids(self, text: bytes) -> bytes:
        words = text.split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(list(dict.fromkeys(words)))
            return b"".join(map(self.known.__getitem__, words))


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this Python worker, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
