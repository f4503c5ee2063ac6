"""Words and shingles of many texts as 64-bit hashes, by whole-array operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text hashed at a time, to bound memory. A longer text is hashed whole, on its own.
CHUNK = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same and ASCII punctuation.
_BREAK = _SPACE.copy()
_BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly (the finish of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of x."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _batches(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    batch, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
        if batch and size + len(raw) > CHUNK:
            yield batch
            batch, size = [], 0
        batch.append(raw)
        size += len(raw) + 1
    if batch:
        yield batch


def words_of(texts: Iterable[str | None], bare: bool = False) -> Iterator[np.ndarray]:
    """For each text the hashes of its words (lower-cased A-Z; runs of bytes other than space and 0x09 to 0x0D), in order. If bare, ASCII punctuation parts words too."""
    for batch in _batches(texts):
        raw = np.frombuffer(b" ".join(batch) + b" ", np.uint8)
        space = (_BREAK if bare else _SPACE)[raw]
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _power(len(raw))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power, dtype=np.uint64)))
        hashes = mixed((total[end] - total[start]) * inverse[start])
        limits = np.searchsorted(start, np.cumsum([len(x) + 1 for x in batch]))
        yield from np.split(hashes, limits[:-1])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words; of fewer words the one of the whole, of none nothing."""
    if not len(words):
        return words
    k = min(n, len(words))
    run = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        run = run * _SHINGLE + words[i : len(words) - k + 1 + i]
    return distinct(mixed(run ^ np.uint64(k)))
