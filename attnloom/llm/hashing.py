"""Hashes of words, word shingles and n-grams, computed over whole Arrow text columns at once.

A word is `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Its hash is a polynomial
over its bytes modulo 2**64, read off prefix sums, then scrambled; sequences of
words combine scrambled word hashes with odd factors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import texts

WIDTH = 5
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: White space and all other ASCII signs, for word features.
SIGNS = _SEPARATOR.copy()
SIGNS[[c for c in range(128) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_FACTORS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SHORT = np.uint64(0x1D8E4E27C47D124F)
_powers: list[np.ndarray] = []


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well mixed bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0][:n], _powers[1]


def _spans(column: pa.Array, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial, its inverse powers, starts and ends of words in bytes, first word of each text."""
    column = texts(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    n = int(offsets[-1] - offsets[0])
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(1, np.uint64), np.zeros(0, np.uint64), none, none, np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8, n, int(offsets[0]))
    offsets = offsets - offsets[0]
    gap = separator[data]
    opens = np.empty(n, bool)
    opens[0], opens[1:] = True, gap[:-1]
    opens[offsets[offsets < n]] = True
    closes = np.empty(n, bool)
    closes[-1], closes[:-1] = True, gap[1:]
    closes[offsets[offsets > 0] - 1] = True
    starts = np.flatnonzero(opens & ~gap)
    ends = np.flatnonzero(closes & ~gap) + 1
    power, inverse = _tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * power, out=sums[1:])
    return sums, inverse, starts, ends, np.searchsorted(starts, offsets)


def words(column: pa.Array, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the index of the first word of each text (one more entry than texts)."""
    sums, inverse, starts, ends, first = _spans(column, separator)
    return scramble((sums[ends] - sums[starts]) * inverse[starts]), first


def words_and_stems(column: pa.Array, separator: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """As `words`, and per size (word index, hash of its first bytes) of all longer words."""
    sums, inverse, starts, ends, first = _spans(column, separator)
    stems = []
    for size in sizes:
        at = np.flatnonzero(ends - starts > size)
        stems.append((at, scramble((sums[starts[at] + size] - sums[starts[at]]) * inverse[starts[at]] + np.uint64(size))))
    return scramble((sums[ends] - sums[starts]) * inverse[starts]), first, stems


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Per text the ascending distinct hashes of its 5-word shingles.

    With one to four words the whole sequence is the one shingle, with none the set is empty.
    """
    hashes, first = words(column)
    counts = np.diff(first)
    usable = max(0, len(hashes) - WIDTH + 1)
    runs = np.zeros(usable, np.uint64)
    for j in range(WIDTH):
        runs += hashes[j : j + usable] * _FACTORS[j]
    runs = scramble(runs)
    out = []
    for row, n in enumerate(counts):
        a = int(first[row])
        if n >= WIDTH:
            own = np.sort(runs[a : a + n - WIDTH + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            total = np.array([n], np.uint64) * _SHORT
            for j in range(n):
                total += hashes[a + j : a + j + 1] * _FACTORS[j]
            out.append(scramble(total))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
