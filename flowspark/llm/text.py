"""Array helpers for texts inside Arrow tasks: words, rolling hashes, bounded chunks.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Hashes are 64-bit and only locate candidates or name words inside one comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20  # text per array step inside a task

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for base in (BASE, inverse):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least ``n`` exponents."""
    return _powers(max(1 << 21, 1 << int(n).bit_length()))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread all input bits over all output bits (one-to-one)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any range by ``range_hash``."""
    forward, _ = powers(len(units))
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * forward[: len(units)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of units[start:end]; equal ranges have equal hashes wherever they stand."""
    _, backward = powers(len(sums))
    return mix((sums[end] - sums[start]) * backward[start])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (strings or binary) and the n + 1 offsets into them; a null text is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def row_chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``limit`` bytes; a longer text stands alone."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of its first word (n + 1)."""
    if len(data) == 0 or bounds[-1] == bounds[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    low = bounds[0]
    space = _IS_SPACE[data[low : bounds[-1]]]
    inner = np.unique(bounds[(bounds > low) & (bounds < bounds[-1])] - low)
    before = np.empty(len(space), bool)
    before[0], before[1:] = True, space[:-1]
    before[inner] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(space), bool)
    after[-1], after[:-1] = True, space[1:]
    after[inner - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts + low, ends + low, np.searchsorted(starts, bounds - low)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash per word; ``lower`` takes A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK_BYTES, "right")))
        low = starts[first]
        part = data[low : ends[last - 1]]
        sums = prefix_sums(_LOWER[part] if lower else part)
        out[first:last] = range_hash(sums, starts[first:last] - low, ends[first:last] - low)
        first = last
    return out


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= BASE
        out += mix(hashes[j : j + n] + np.uint64(j + 1))
    return mix(out)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its lower-cased ``size``-word shingles.

    A text of fewer words is one shingle of all its words; one without words has none.
    """
    starts, ends, first = word_bounds(data, bounds)
    hashes = word_hashes(data, starts, ends, lower=True)
    grams = gram_hashes(hashes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            # the count enters the hash, so a short text equals no longer one
            yield mix(gram_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
