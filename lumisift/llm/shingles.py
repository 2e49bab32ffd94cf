"""Sets of word shingles as sorted arrays of 64-bit hashes, from whole Arrow columns of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of words hashed at a time.
CHUNK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False

_BYTES = np.random.Generator(np.random.PCG64(11)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that all bits depend on all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(count: int) -> np.ndarray:
    out = np.full(count, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where the words of each text start in them (one more entry than texts).

    Words are what stands between blanks and tabs to carriage returns; with ``fold``, A-Z are lower-cased.
    A null text has no words.
    """
    data = texts.cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    size = int(at[-1] - at[0]) if len(data) else 0
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(data) + 1, np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8, size, int(at[0]))
    at = at - at[0]
    inside = _IN_WORD[raw]
    heads = np.unique(at[at < size])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + CHUNK)))
        lengths = ends[low:high] - starts[low:high]
        begin = np.cumsum(lengths) - lengths
        inner = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        letters = raw[np.repeat(starts[low:high], lengths) + inner]
        values = _BYTES[_FOLD[letters] if fold else letters] * _powers(int(lengths.max()))[inner]
        hashes[low:high] = mix(np.add.reduceat(values, begin))
        low = high
    return hashes, np.searchsorted(starts, at)


def chain(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` words."""
    count = len(words) - size + 1
    powers = _powers(size)
    total = np.full(count, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        total += words[i:i + count] * powers[i]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words.

    A text with fewer words has one shingle of all of them, one without words has none.
    """
    words, at = word_hashes(texts)
    for low, high in zip(at[:-1], at[1:], strict=True):
        count = int(high - low)
        if not count:
            yield np.empty(0, np.uint64)
        else:
            yield np.unique(chain(words[low:high], min(size, count)))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever the order, as two signed numbers."""
    one = np.bitwise_xor.reduce(mix(hashes + np.uint64(1)), initial=np.uint64(0))
    two = np.add.reduce(mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)))
    return int(one.view(np.int64)), int(np.uint64(two).view(np.int64))


def overlap(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    return len(np.intersect1d(left, right, assume_unique=True))
