"""Vectorised 5-word shingling of UTF-8 buffers with numpy.

A text's words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are lower-cased.  Its
shingle set holds the distinct hashes of every `width` consecutive words; a text with fewer words
(but at least one) has one shingle, the whole sequence; a text without words has none.

Hashes are 64 bits wide: a polynomial over the bytes of a word (a prefix sum gives all words of a buffer
at once), mixed with the word's length, then a mixed linear form over the words of a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = [((i + 1) * 0xD6E8FEB86659FD93 | 1) & _MASK for i in range(64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Texts are handled in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 18


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class _Powers:
    """BASE**i and BASE**-i modulo 2**64 for all i below a size that doubles on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.full(size, _U(_BASE)), np.full(size, _U(_INVERSE))
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text) for texts `data[offsets[i]:offsets[i + 1]]`."""
    if len(data) == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    data = _LOWER[data]
    blank = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, blank[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, blank[1:]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * down[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * up[starts]
    h = mix64(h + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))
    return h, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n = len(offsets) - 1
    words, text = word_hashes(data, offsets)
    if len(words) == 0:
        return [np.zeros(0, _U)] * n
    first = np.searchsorted(text, np.arange(n + 1))
    counts = np.diff(first)
    m = max(0, len(words) - width + 1)
    h = np.full(m, _U(width), dtype=_U)
    for k in range(width):
        h = mix64(h + words[k : k + m] * _U(_WEIGHTS[k]))
    out = []
    for i in range(n):
        a, c = first[i], counts[i]
        if c >= width:
            s = np.sort(h[a : a + c - width + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif c:
            v = np.array([c], dtype=_U)
            for k in range(c):
                v = mix64(v + words[a + k : a + k + 1] * _U(_WEIGHTS[k]))
            out.append(v)
        else:
            out.append(np.zeros(0, _U))
    return out


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of about RUN_BYTES; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    _, where, data = column.buffers()
    where = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(where, where[i] + RUN_BYTES, side="right")) - 1)
        yield i, data[where[i] : where[j]], where[i : j + 1] - where[i]
        i = j
