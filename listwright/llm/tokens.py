"""Token ids of whole texts by a public word BPE, with a bounded memory of words per worker.

The vocabulary cuts a text into runs of letters, single digits and runs of other characters
before any merge, so a text's ids are those of its cuts one after the other, and a cut that
came before need not be encoded again. In Latin letters the cuts are found with one pattern;
a text with any other character goes through the tokenizer whole.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
_LATIN = re.compile("[\x00-įı-ſ]*")
# The vocabulary's own cuts, written for lower-cased characters up to U+017F.
_LETTER = "a-zªµºß-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t-\r \x85\xa0{_LETTER}{_DIGIT}]+")
_REMEMBERED = 1_200_000


def _byte_letters() -> dict[int, str]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, others follow 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(256 + i) for i, b in enumerate(others)}


_AS_LETTERS = _byte_letters()


class WordEncoder:
    """Ids of texts; ``ordinary`` reads the strings of special tokens as plain text."""

    def __init__(self, path: str | None = None, ordinary: bool = False):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(WORD_BPE))
        self.tokenizer.encode_special_tokens = ordinary
        self.special = not ordinary
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cuts: list[str]) -> None:
        one = self.tokenizer.model.tokenize
        # Printable ASCII stands for itself.
        spelt = [c if c.isascii() and c.isprintable() else c.encode().decode("latin-1").translate(_AS_LETTERS) for c in cuts]
        found = [[t.id for t in one(c)] for c in spelt]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total = int(lengths.sum())
        flat = np.fromiter(chain.from_iterable(found), np.uint32, total)
        n, m = len(self.place), len(cuts)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + total] = flat
        self.begin[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + m] = lengths
        self.used += total
        self.place.update(zip(cuts, range(n, n + m), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the place where each text begins.

        Millions of strings are made here and no cycles, so the collector of cycles waits.
        """
        waits = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if waits:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > _REMEMBERED:
            self.forget()
        known = [bool(_LATIN.fullmatch(t)) and not (self.special and "<|" in t) for t in texts]
        split = [_CUT.findall(t.lower()) if k else [] for t, k in zip(texts, known, strict=True)]
        cuts = [c for cs in split for c in cs]
        place = np.fromiter(map(self.place.get, cuts, repeat(-1)), np.int64, len(cuts))
        new = np.flatnonzero(place < 0)
        if len(new):
            self._learn(list(dict.fromkeys(cuts[i] for i in new)))
            place[new] = [self.place[cuts[i]] for i in new]
        length = self.length[place]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[place] - (ends - length), length) + np.arange(total)]
        counts = np.cumsum([0, *map(len, split)])
        bounds = np.concatenate([[0], ends])[counts]
        if all(known):
            return ids, bounds
        other = iter(self._whole([t for t, k in zip(texts, known, strict=True) if not k]))
        parts = [
            ids[bounds[i] : bounds[i + 1]] if k else np.array(next(other), np.uint32) for i, k in enumerate(known)
        ]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


_encoders: dict[tuple[str | None, bool], WordEncoder] = {}


def encoder(path: str | None = None, ordinary: bool = False) -> WordEncoder:
    """One encoder for each Python worker."""
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = WordEncoder(path, ordinary)
    return _encoders[path, ordinary]


def slices(texts: Iterable[str | None], chars: int = 1 << 20):
    """Runs of texts of about so many characters; a null counts as empty."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
