"""Two-stage suffix sorting of many short strings, as array operations.

Stage one sorts directly only the suffixes that are smaller than their successors (the suffix one
position later). Stage two induces all others by one scan of the buckets of first symbols, in
ascending order: the predecessors of a bucket's suffixes, in their order, are appended to their own buckets.
The order holds for the first ``depth`` symbols; suffixes that agree in them stand side by side.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as such."""
    n = len(s)
    less = np.zeros(n, np.bool_)
    if not n:
        return less
    change = np.flatnonzero(s[1:] != s[:-1])  # the ends of runs of one symbol
    rises = np.concatenate([s[change] < s[change + 1], [True]])
    return np.repeat(rises, np.diff(np.concatenate([[-1], change, [n - 1]])))


def prefix_words(s: np.ndarray) -> np.ndarray:
    """The eight symbols from each position on as one big-endian number; zeros stand behind the end."""
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    out = np.zeros(len(s), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(s)].astype(np.uint64)
    return out


def direct_sort(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols: by eight symbols, then only the ties by the next eight."""
    word = lambda p, k: words[np.minimum(p + k, len(words) - 1)]
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else np.zeros(0, np.int64)
    tied = np.arange(len(at))
    for k in range(8, depth, 8):
        same = group[1:] == group[:-1]
        live = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(group) else np.zeros(0, np.bool_)
        tied, group = tied[live], group[live]
        if not len(tied):
            break
        p = at[tied]
        key = word(p, k)
        order = np.lexsort((key, group))
        at[tied], key, old = p[order], key[order], group[order]
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (old[1:] != old[:-1]))])
    return at


def suffix_order(s: np.ndarray, words: np.ndarray | None = None, depth: int = 56) -> np.ndarray:
    """All suffixes of ``s`` (uint8, the last symbol smaller than any other or a separator 0) by their first ``depth`` symbols."""
    n = len(s)
    words = prefix_words(s) if words is None else words
    less = smaller_than_next(s)
    order = np.empty(n, np.int64)
    size = np.bincount(s, minlength=256)
    end = np.cumsum(size)
    small = np.bincount(s[less], minlength=256)
    direct = direct_sort(np.flatnonzero(less), words, depth)
    split = np.cumsum(small)
    for c in np.flatnonzero(small):
        order[end[c] - small[c] : end[c]] = direct[split[c] - small[c] : split[c]]
    head = end - size  # where the next induced suffix of each bucket goes

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~less[before]]
        symbol = s[before]
        by = np.argsort(symbol, kind="stable")
        count = np.bincount(symbol, minlength=256)
        place = np.repeat(head - (np.cumsum(count) - count), count) + np.arange(len(before))
        order[place] = before[by]
        head[:] += count

    for c in np.flatnonzero(size):
        done = end[c] - size[c]
        while done < head[c]:  # induced ones; runs of this symbol induce more of them
            upto = int(head[c])
            induce(order[done:upto])
            done = upto
        induce(order[end[c] - small[c] : end[c]])
    return order


def shares_prefix(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of an order has ``length`` (8 or more) common first symbols with the one before it."""
    out = np.zeros(len(order), np.bool_)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    last = len(words) - 1
    for k in [*range(0, length - 8, 8), length - 8]:
        live = live[words[np.minimum(a[live] + k, last)] == words[np.minimum(b[live] + k, last)]]
    out[live + 1] = True
    return out
