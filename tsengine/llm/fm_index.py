"""An FM-index over a sequence of integer symbols, with all queries answered at once as arrays."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the last symbol of ``s`` must be smaller than all others."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Ranks of any symbol in a sequence: a bit vector with prefix counts for each binary digit of the symbols."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.levels - 1, -1, -1):
            digit = (s >> bit & 1).astype(np.bool_)
            count = np.zeros(len(s) + 1, np.int32)
            np.cumsum(digit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(s) - int(count[-1]))
            s = np.concatenate([s[~digit], s[digit]])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            digit = symbol >> (self.levels - 1 - level) & 1
            up = ones[at]
            at = np.where(digit == 1, zeros + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self._down(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, its rank there)."""
        symbol, place = np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[place]
            digit = ones[place + 1] - up
            symbol = symbol * 2 + digit
            place = np.where(digit == 1, zeros + up, place - up)
        return symbol, place - self._down(symbol, np.zeros_like(at))


class FMIndex:
    """Count and locate phrases by backward search; every ``every``-th text position is sampled."""

    def __init__(self, s: np.ndarray, symbols: int, every: int = 8):
        order = suffix_array(s)
        self.n, self.symbols = len(s), symbols
        self.tree = WaveletMatrix(s[order - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        sampled = order % every == 0
        self.sample_at = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled, self.samples = sampled, order[sampled]

    def search(self, text: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [low, high) of each phrase; a phrase is ``lengths`` symbols of ``text`` from ``start`` on."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        for k in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            c = text[start[live] + lengths[live] - 1 - k]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text position) of every occurrence."""
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(low)), count)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
        found, steps, live = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.arange(len(row))
        while len(live):
            at = row[live]
            hit = self.sampled[at]
            found[live[hit]] = self.samples[self.sample_at[at[hit]]] + steps[live[hit]]
            live = live[~hit]
            symbol, rank = self.tree.access(row[live])
            row[live] = self.before[symbol] + rank
            steps[live] += 1
        return phrase, found
