"""Probabilistic automata from example strings by state merging (the ALERGIA rule)."""

from __future__ import annotations

import math

#: A character's class, so that one example stands for others of its format: digits, hex letters, vowels and consonants of either case; other characters stand for themselves.
_CLASS = {c: k for k, cs in {"0": "0123456789", "x": "abcdef", "v": "iouy", "c": "ghjklmnpqrstvwxz", "X": "ABCDEF", "V": "IOUY", "C": "GHJKLMNPQRSTVWXZ"}.items() for c in cs}
SYMBOLS = "0xvcXVC" + "+/_.=-"
#: The first symbol of a string tells its length: one symbol a length up to LONG, one for all beyond.
LONG, HEAD = 128, 0x100


def symbols_of(text: str, fixed: str = "") -> str:
    """Length, fixed prefix (one symbol, if the string has it) and the classes of the other characters."""
    head = "P" if fixed and text.startswith(fixed) else ""
    return chr(HEAD + min(len(text), LONG)) + head + "".join(_CLASS.get(c, c) for c in text[len(fixed) if head else 0 :])


class Automaton:
    """States with counts of arrivals, ends and steps; merged while their counts can come from one distribution."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.seen = [0], [0]
        for s in strings:
            at = 0
            for c in s:
                self.seen[at] += 1
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.seen.append(0)
                at = self.next[at][c]
            self.seen[at] += 1
            self.ends[at] += 1
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _apart(self, a: int, b: int) -> bool:
        n, m = self.seen[a], self.seen[b]
        if not n or not m:
            return False
        most = self.slack * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if abs(self.ends[a] / n - self.ends[b] / m) > most:
            return True
        return any(abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > most for c in {*self.count[a], *self.count[b]})

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._apart(a, b):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        kept, edge = [0], [(0, c) for c in sorted(self.next[0])]
        while edge:
            at, c = edge.pop(0)
            b = self.next[at][c]
            if b in kept:
                continue
            for a in kept:
                if self._compatible(a, b):
                    self.next[at][c] = a
                    self._fold(a, b)
                    break
            else:
                kept.append(b)
            edge = sorted({(k, c) for k in kept for c, to in self.next[k].items() if to not in kept})
        index = {k: i for i, k in enumerate(kept)}
        width = len(SYMBOLS) + 2  # with the fixed prefix and the end; the length is a symbol of the first state only
        self.step = [{c: (index[to], math.log((self.count[k].get(c, 0) + 0.05) / (self.seen[k] + 0.05 * width))) for c, to in self.next[k].items() if to in index} for k in kept]
        self.end = [math.log((self.ends[k] + 0.05) / (self.seen[k] + 0.05 * width)) for k in kept]
        self.miss = [math.log(0.05 / (self.seen[k] + 0.05 * width)) for k in kept]
        self.next, self.count = [], []

    def score(self, s: str) -> float:
        """Mean log likelihood a symbol, its end included; after a step never seen it stays in its state."""
        at, total = 0, 0.0
        for c in s:
            to = self.step[at].get(c)
            if to is None:
                total += self.miss[at]
            else:
                at, gain = to
                total += gain
        return (total + self.end[at]) / (len(s) + 1)
