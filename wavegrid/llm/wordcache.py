"""Token ids of word lists, where each distinct word is encoded once by a worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from .common import gathered

#: Encodes words: all ids, and how many each word has.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Numbers(dict):
    """The number of each word; a word that has none gets the next and is listed in ``new``."""

    new: list[str]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordCache:
    """Remembers words until there are ``limit``, then starts anew with the next batch: some 200 bytes a word."""

    def __init__(self, encode: Encoder, limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint32)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        """``a`` with room for n values: twice as long if it has less."""
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def ids(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents one after another, and each document's number of ids."""
        if len(self.number) >= self.limit:
            self.clear()
        words, known, self.number.new = list(chain.from_iterable(docs)), len(self.number), []
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        total = len(self.number)
        if total > known:
            flat, length = self.encode(self.number.new)
            self.flat, self.start, self.length = self._room(self.flat, self.used + len(flat)), self._room(self.start, total), self._room(self.length, total)
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[known:total] = self.used + np.cumsum(length) - length
            self.length[known:total] = length
            self.used += len(flat)
        length = self.length[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum([len(d) for d in docs], dtype=np.int64)])]
        return self.flat[gathered(self.start[at].astype(np.int64), length)], np.diff(ends)
