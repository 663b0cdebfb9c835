"""Vectorised text hashing inside tasks: byte buffers, prefix polynomial hashes, word and shingle hashes.

Arithmetic is modulo 2**64 (numpy wraps). A prefix sum ``P[i] = sum(T[c_j] * B**j, j < i)`` gives the hash of
any substring from two look-ups and one multiplication by a power of the inverse of ``B``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A byte costs dozens of bytes of 64-bit arrays, so a slice of this size takes about 40 MB of a worker.
SLICE_BYTES = 512 << 10
#: The bytes that Python's bytes.split() and the word rule [^\x20\x09-\x0D]+ treat as white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """At least ``n`` powers of ``base``, kept while they are large enough."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(1 << max(16, int(n - 1).bit_length()), base, dtype=np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.cumprod(known, dtype=np.uint64)
    return known


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums, one longer than ``data``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(len(sums), BASE_INVERSE)[start])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (a longer row comes alone): first row, bytes, offsets."""
    column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the number of words before each row (one more than rows)."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts] & inside[cuts - 1]]  # a word at a row's end and one at the next row's start
    first[both] = True
    last[both - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a row, and how many come before each row.

    A row of fewer words, but not none, gives one hash of its whole sequence.
    """
    counts = np.diff(before)
    short = (counts > 0) & (counts < n)
    per_row = np.where(short, 1, np.maximum(counts - n + 1, 0))
    bounds = np.concatenate(([0], np.cumsum(per_row)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - before[:-1], per_row)
    out = np.zeros(bounds[-1], dtype=np.uint64)
    length = np.repeat(np.minimum(counts, n), per_row)
    padded = np.concatenate((words, np.zeros(n, dtype=np.uint64)))
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(k < length, padded[at + k], np.uint64(k + 1))
    return mix(out), bounds
