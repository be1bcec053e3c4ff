"""Vectorised word hashing over Arrow string columns.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. All functions work on
UTF-8 bytes: white space and A-Z are single bytes there, so no text is decoded.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SHINGLE = 5


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0): runs of rows of at most so many bytes, or one longer row."""
    data, offsets = string_buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans_of(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds) of the runs of solid bytes, none across rows; row i has the runs bounds[i] to bounds[i + 1]."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[offsets] = True
    before, after = solid.copy(), solid.copy()
    before[1:] &= ~solid[:-1] | edge[1:-1]
    after[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(before)
    return start, np.flatnonzero(after) + 1, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, with A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _grown(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each row's words)."""
    start, end, bounds = spans_of(~_BLANK[data], offsets)
    return span_hashes(data, start, end), bounds


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, at its first word; the last n - 1 places are dropped."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + words[k : k + len(out)]
    return mix(out)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; with fewer than n words, the hash of the whole sequence; without words, none."""
    for first, last, data, offsets in slices(column):
        words, bounds = word_hashes(data, offsets)
        grams = gram_hashes(words, n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            else:
                yield gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


_CLASS = np.full(256, 2, np.uint8)
_CLASS[_BLANK] = 0
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def is_word(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a letter, a digit, an underscore or beyond ASCII."""
    return _CLASS[data] == 1


def piece_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like word_hashes, for runs of word characters and runs of punctuation."""
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    return span_hashes(data, start, end), np.searchsorted(start, offsets)
