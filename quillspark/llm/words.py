"""Words of whole texts as row numbers of a bounded per-worker table of word values."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import xxhash

from quillspark.llm.common import LETTERS


def hashed(features: Iterable[str], buckets: int) -> list[int]:
    """Bucket of each feature, the same in every process."""
    h = xxhash.xxh3_64_intdigest
    return [h(x) % buckets for x in features]


class WordTable(dict):
    """Row of each lower-case word in the arrays `values`; make(words) makes the rows of new words."""

    def __init__(self, make: Callable[[list[str]], list[np.ndarray]], most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most
        self.new: list[str] = []
        self.values: list[np.ndarray] | None = None

    def __missing__(self, word: str) -> int:
        n = len(self)
        self[word] = n
        self.new.append(word)
        return n

    def rows(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of the texts one after another, and each text's number of words.

        The values of all rows are there afterwards. The table starts anew when it is full;
        it holds the words of these texts at least.
        """
        if len(self) > self.most:
            self.clear()
            self.values = None
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        out = np.fromiter((self[w] for ws in found for w in ws), np.int32, int(counts.sum()))
        if self.new or self.values is None:
            new, self.new = self.new, []
            for at in range(0, max(1, len(new)), 4096):
                made = self.make(new[at : at + 4096])
                if self.values is None:
                    self.room, self.used, self.values = [np.empty((8192, *x.shape[1:]), x.dtype) for x in made], 0, []
                to = self.used + len(made[0])
                while to > len(self.room[0]):
                    self.room = [np.concatenate([x, np.empty_like(x)]) for x in self.room]
                for x, own in zip(self.room, made, strict=True):
                    x[self.used : to] = own
                self.used = to
            self.values = [x[: self.used] for x in self.room]
        return out, counts


def groups_of(counts: np.ndarray, most: int) -> Iterable[tuple[int, int]]:
    """Ranges of texts of at most `most` words together, or of one text."""
    at = 0
    while at < len(counts):
        to, total = at + 1, counts[at]
        while to < len(counts) and total + counts[to] <= most:
            total += counts[to]
            to += 1
        yield at, to
        at = to
