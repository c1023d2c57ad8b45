"""Words and hashes of batches of texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about this many bytes; a longer one is alone.
PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
GOLDEN = 0x9E3779B97F4A7C15


def powers(n: int, base: int) -> np.ndarray:
    """``base**0 .. base**(n - 1)`` modulo 2**64."""
    out = np.empty(max(1, n), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_BASE = 0x2545F4914F6CDD1D
_BACK = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = powers(PIECE, _BASE), powers(PIECE, _BACK)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (bytes, unchanged), and each text's number of words.

    A word's hash is a polynomial of its bytes, read off prefix sums that are made
    ``PIECE`` bytes at a time, so the tables of powers don't grow with a text.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[data]
    begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    at = np.cumsum([1] + [len(t) + 1 for t in texts])
    count = np.diff(np.searchsorted(begin, at))
    low, high = np.empty(len(begin), np.uint64), np.empty(len(end), np.uint64)
    carry, back = np.uint64(0), np.empty(len(begin), np.uint64)
    for lo in range(0, len(data), PIECE):
        part = data[lo : lo + PIECE]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((part + np.uint64(1)) * _UP[: len(part)], out=total[1:])
        total = total * np.uint64(pow(_BASE, lo, 1 << 64)) + carry
        carry = total[-1]
        i, j = np.searchsorted(begin, [lo, lo + len(part)])
        low[i:j] = total[begin[i:j] - lo]
        back[i:j] = _DOWN[begin[i:j] - lo] * np.uint64(pow(_BACK, lo, 1 << 64))
        i, j = np.searchsorted(end, [lo, lo + len(part)])
        high[i:j] = total[end[i:j] - lo]
    return mix((high - low) * back), count


def shingles(words: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words that starts at each position, and whether it lies in one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    p = powers(k, GOLDEN)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : n + j] * p[j]
    end = np.repeat(np.cumsum(count), count)
    return mix(h), np.arange(k, n + k) <= end[:n]


def grouped(texts: list[bytes], most: int = PIECE) -> Iterator[list[int]]:
    """Indexes of texts in groups of about ``most`` bytes; a longer text is alone."""
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of the texts of an Arrow column."""
    return column.cast(pa.binary()).to_pylist()
