"""Word and window hashes of many texts at once, on the bytes of an Arrow column.

Words are runs of bytes outside space and U+0009 to U+000D, which is the same on UTF-8 bytes and on code points. Hashes
have 64 bits; equal hashes stand for equal words, as far as 64 bits tell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = pow(int(_BASE), -1, 1 << 64)
_POWERS: dict[bool, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, back: bool = False) -> np.ndarray:
    """The first powers of the base, or of its inverse, at least ``n`` of them; kept up to some size."""
    kept = _POWERS.get(back)
    if kept is not None and len(kept) >= n:
        return kept
    steps = np.full(max(64, n), np.uint64(_INVERSE) if back else _BASE, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps, dtype=np.uint64)
    if n <= 4_000_000:
        _POWERS[back] = powers
    return powers


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array, lower: bool = False, breaks: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the number of words before each row (and after all), and the byte where each word starts.

    ``lower`` folds A-Z; ``breaks`` are more bytes that end a word and belong to none.
    """
    return words_in(*raw(column), lower, breaks)[:3]


def words_in(
    data: np.ndarray, bounds: np.ndarray, lower: bool = False, breaks: bytes = b""
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words`` for rows given as bytes and offsets, and the number of bytes of each word."""
    none = np.zeros(0, np.int64)
    space = _SPACE
    if breaks:
        space = _SPACE.copy()
        space[list(breaks)] = True
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), none, none
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), none, none
    # a word ends where a space or another row begins
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    lengths = np.flatnonzero(last) + 1 - starts
    table = _FOLDED if lower else _BYTES
    hashes = mix(_between(table[data], starts, lengths) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds).astype(np.int64), starts, lengths


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words that starts at a word, and whether it lies within one row."""
    n = len(hashes)
    if n < size:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    salt = _powers(size + 1)
    for j in range(size):
        out[: n - size + 1] += hashes[j : n - size + 1 + j] * salt[j + 1]
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # words from here to the end of the row
    return mix(out), left >= size


def _between(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Polynomial of each stretch of values, the same wherever it lies: prefix sums, moved back to the first power."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(n)[:n], dtype=np.uint64, out=sums[1:])
    return (sums[begin + length] - sums[begin]) * _powers(n, back=True)[begin]


def stretches(hashes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of any stretch of words."""
    return mix(_between(hashes, begin, length) + length.astype(np.uint64))


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def sum_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; modulo 2**64 for hashes."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]
