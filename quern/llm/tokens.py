"""Token ids of texts, with the words seen so far kept.

The vocabularies read here never merge across white space, so a text's ids are
those of its words in a row.  Only words not met before reach the tokenizer.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np

from .common import spans_of

#: At so many words, or pieces of words, a table of known ones starts anew.
MOST_WORDS, MOST_PIECES = 600_000, 1_100_000
#: Pieces that are encoded together.
TOGETHER = 100
#: Marks that may follow the letters of a plain word; each is a piece of its own.
_MARKS = frozenset(".,;:!?")
#: Letters whose lower case depends on what follows, or takes two code points.
_ODD_CASE = re.compile("[\u03a3\u0130]")
#: Code points that str.split takes for white space and the tokenizer's pattern may not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class _Numbers(dict):
    """Gives each new word the next number and lists it as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordTokenizer:
    """Encodes with a word-wise tokenizer file of the ``tokenizers`` library."""

    def __init__(self, file: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(file)
        self.inner.encode_special_tokens = special_as_text
        # Pieces are encoded many at once, with a special token between them that none of them holds.
        self.many = Tokenizer.from_file(file)
        special = {t.content: i for i, t in self.many.get_added_tokens_decoder().items() if t.special}
        self.between, self.between_id = min(special.items(), default=("", -1))
        self._clear()

    @staticmethod
    @cache
    def shared(file: str, special_as_text: bool = False) -> WordTokenizer:
        """One per Python worker."""
        return WordTokenizer(file, special_as_text)

    def _clear(self) -> None:
        self.pieces = _Numbers()
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.known = self.used = 0
        self.pieces[""]  # piece 0 has no ids
        self._clear_words()

    def _clear_words(self) -> None:
        self.words = _Numbers()
        self.parts = np.zeros((1 << 16, 2), np.int64)
        self.split = 0

    def _pieces_of(self, word: str) -> tuple[int, int]:
        """A plain word's letters in lower case and its mark; of other words the whole."""
        letters, mark = (word[:-1], word[-1]) if word[-1] in _MARKS else (word, "")
        if letters.isalpha() and (letters.isascii() or is_normalized("NFC", letters) and not _ODD_CASE.search(letters)):
            return self.pieces[letters.lower()], self.pieces[mark]
        return self.pieces[word], 0

    def _learn(self) -> None:
        """Splits the new words, and encodes the new pieces."""
        new = self.words.new
        while self.split + len(new) > len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
        if new:
            self.parts[self.split : self.split + len(new)] = np.fromiter(chain.from_iterable(map(self._pieces_of, new)), np.int64, 2 * len(new)).reshape(-1, 2)
            self.split += len(new)
            new.clear()
        new = self.pieces.new
        if not new:
            return
        parts = [self._encoded(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
        sizes, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        while self.known + len(new) > len(self.sizes):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        at = slice(self.known, self.known + len(new))
        self.sizes[at] = sizes
        self.starts[at] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.known, self.used = at.stop, self.used + len(flat)
        new.clear()

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids in a row."""
        joined = self.between.join(pieces)
        if self.between and joined.count("<|") == len(pieces) - 1 == joined.count(self.between):
            ids = np.array(self.many.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.between_id), len(ids))
            return np.diff(ends, prepend=-1) - 1, ids[ids != self.between_id]
        found = [e.ids for e in self.inner.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """The ids (uint32) of each text, with ``end_id`` after them if one is given."""
        if len(self.pieces) > MOST_PIECES:
            self._clear()
        elif len(self.words) > MOST_WORDS:
            self._clear_words()
        out: list[np.ndarray | None] = [None] * len(texts)
        end = [] if end_id is None else [end_id]
        plain = []
        for i, text in enumerate(texts):
            if _ODD_SPACE.search(text):
                out[i] = np.array(self.inner.encode(text, add_special_tokens=False).ids + end, np.uint32)
            else:
                plain.append(i)
        words = [texts[i].split() for i in plain]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        self._learn()
        pieces = self.parts[flat].ravel()
        sizes = self.sizes[pieces]
        ids = self.ids[np.repeat(self.starts[pieces], sizes) + spans_of(sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[2 * np.concatenate([[0], np.cumsum(counts)])]
        for k, i in enumerate(plain):
            out[i] = np.append(ids[ends[k] : ends[k + 1]], np.array(end, np.uint32))
        return out
