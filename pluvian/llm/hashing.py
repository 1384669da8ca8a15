"""Word hashes and rolling window hashes over many documents at a time, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash

#: An odd multiplier and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MEMO_WORDS = 500_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; forgets everything when it has grown too large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def stretches(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[begin:end] for each pair; equal stretches have equal hashes wherever they stand."""
    n = len(values)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _powers(BASE, n), dtype=np.uint64)])
    size = (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed((sums[end] - sums[begin]) * _powers(INVERSE, n + 1)[begin] ^ size)


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` values, by place."""
    begin = np.arange(max(0, len(values) - length + 1))
    return stretches(values, begin, begin + length)


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in every run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, span = np.arange(len(values)), 1

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[left] <= values[right], left, right)
    while span * 2 <= width:
        best = better(best[:-span], best[span:])
        span *= 2
    return better(best[:n], best[width - span:width - span + n])


def groups(items: Iterable, size: Callable[[object], int], least: int) -> Iterator[list]:
    """Items in lists whose sizes sum to about `least`; a single large item makes a list of its own."""
    part, total = [], 0
    for item in items:
        part.append(item)
        total += size(item)
        if total >= least:
            yield part
            part, total = [], 0
    if part:
        yield part
