"""Scores of words by hashed features, remembered for words that recur."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * _MIX
    return h ^ (h >> np.uint64(29))


def feature_buckets(words: list[str], sizes: Iterable[int], bits: int, prefixes: Iterable[int] = (), suffixes: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: (bucket, index of the word), for the word itself, its n-grams with border marks,
    and the affixes of the given lengths."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[owner]
    powers = np.cumprod(np.full(int(lengths.max()), _MULTIPLIER))
    whole = np.add.reduceat(points * powers[place], starts)
    found, owners = [_mixed(whole, 1)], [np.arange(len(words))]
    sizes, prefixes, suffixes = set(sizes), set(prefixes), set(suffixes)
    h = np.zeros(len(points) + 1, np.uint64)
    room = ends[owner]
    for n in range(1, max([0, *sizes, *(x + 1 for x in prefixes | suffixes)]) + 1):
        h = h[:-1] * _MULTIPLIER + points[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(np.arange(len(h)) + n <= room[: len(h)])
            found.append(_mixed(h[at], 2 + n))
            owners.append(owner[at])
        if n - 1 in prefixes:
            own = np.flatnonzero(lengths > n)
            found.append(_mixed(h[starts[own]], 100 + n))
            owners.append(own)
        if n - 1 in suffixes:
            own = np.flatnonzero(lengths > n)
            found.append(_mixed(h[ends[own] - n], 200 + n))
            owners.append(own)
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


class WordTable:
    """Rows of scores by word, computed for many new words at once; emptied at a bound, which changes no score."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], most_words: int = 250_000, most_letters: int = 8 << 20) -> None:
        self.score, self.most_words, self.most_letters = score, most_words, most_letters
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.letters, self.parts = 0, []
        self.table: np.ndarray | None = None

    def rows(self, words: list[str]) -> np.ndarray:
        """The scores of each word, one row a word."""
        if len(self.index) > self.most_words or self.letters > self.most_letters:
            self._empty()
        index = self.index
        at = list(map(index.get, words))
        if None in at or self.table is None:
            new = list({w for w, i in zip(words, at) if i is None})
            for w in new:
                index[w] = len(index)
            self.letters += sum(map(len, new))
            scores = np.asarray(self.score(new), np.float32)
            used = len(index) - len(new)
            if self.table is None or len(self.table) < len(index):
                grown = np.zeros((max(1024, len(index) * 3 // 2), scores.shape[1]), np.float32)
                if self.table is not None:
                    grown[:used] = self.table[:used]
                self.table = grown
            self.table[used : len(index)] = scores
            at = list(map(index.__getitem__, words))
        return self.table[np.array(at, np.int64)]
