"""Words of many texts at once, as arrays.

A word is a run of digits, letters a-z (A-Z lower-cased) and code points above U+007F, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. All bytes of a non-ASCII code point
are word bytes, so the split is done on UTF-8 bytes without decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64, utf8_pieces

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, np.bool_)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_IS_WORD[65:91] = True
#: A random odd-looking 64-bit value for each lower-cased byte, and the multiplier of the polynomial hash.
_VALUE = mix64(_LOWER.astype(np.uint64) + np.uint64(1), 7)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 21:
            _powers[base] = have
    return have[:n]


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, first byte, end byte, 64-bit hash) of all words of a run of rows."""
    inside = _IS_WORD[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    edge = np.empty(n, np.bool_)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cut = starts[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut - 1]]  # words that touch across two rows
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, np.repeat(np.unique(cut), 2)]))
    if len(at) % 2:
        at = np.append(at, n)
    first, end = at[::2], at[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, n), out=total[1:])
    code = mix64((total[end] - total[first]) * _power(_INVERSE, n + 1)[first] + (end - first).astype(np.uint64))
    row = np.searchsorted(starts, first, "right") - 1
    return row, first, end, code


def word_parts(values: pa.Array, limit: int = 1 << 20):
    """The words of a string array in parts of about ``limit`` bytes, so a text of any length takes no more memory than its words need.

    Yields (first row, number of rows, row, first byte, end byte, hash, begins, ends): rows counted from the first one of the part, bytes
    from the start of each text. A part is a run of whole rows, or a piece of one long row, cut between words; begins and
    ends tell whether it holds the row's first and last words. A word is never cut, however long.
    """
    for at, data, starts in utf8_pieces(values, limit):
        if len(starts) > 2 or len(data) <= 2 * limit:
            row, first, end, code = words_of(data, starts)
            yield at, len(starts) - 1, row, first - starts[row], end - starts[row], code, True, True
            continue
        begin = 0
        while begin < len(data):
            stop = min(begin + limit, len(data))
            while stop < len(data):
                inside = _IS_WORD[data[stop : stop + 4096]]
                gap = int(inside.argmin())
                stop += len(inside) if inside[gap] else gap
                if not inside[gap]:
                    break
            row, first, end, code = words_of(data[begin:stop], np.array([0, stop - begin]))
            yield at, 1, row, first + begin, end + begin, code, begin == 0, stop == len(data)
            begin = stop


def shingle_parts(values: pa.Array, size: int, limit: int = 1 << 20):
    """(first row, number of rows, row, shingle hash) of runs of whole rows; of a long row its words come in parts, its shingles at once."""
    kept: list[np.ndarray] = []
    carry = np.zeros(0, np.uint64)
    for at, n, row, _, _, code, begins, ends in word_parts(values, limit):
        if begins and ends:
            yield at, n, *shingles(code, row, size)
            continue
        code = code if begins else np.concatenate([carry, code])
        carry = code[max(0, len(code) - size + 1) :]
        if len(code) >= size:
            kept.append(shingles(code, np.zeros(len(code), np.int64), size)[1])
        if ends:
            codes = np.concatenate(kept) if kept else shingles(code, np.zeros(len(code), np.int64), size)[1]
            kept, carry = [], np.zeros(0, np.uint64)
            yield at, n, np.zeros(len(codes), np.int8), codes


def shingles(code: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words inside a row; a shorter row, not empty, is one shingle."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[start, n])
    out = np.zeros(n, np.uint64)
    padded = np.concatenate([code, np.zeros(size, np.uint64)])
    left = np.repeat(length, length) - (np.arange(n) - np.repeat(start, length))
    for k in range(size):
        part = mix64(padded[k : n + k], k + 1)
        out += np.where(left > k, part, np.uint64(0))
    out = mix64(out, size)
    keep = left >= size
    keep[start[length < size]] = True
    return row[keep], out[keep]
