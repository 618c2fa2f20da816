"""Words and n-grams of Arrow text columns, hashed with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Every helper takes null
text as empty and bounds its scratch memory by SLICE_BYTES, but for a single
longer document, which is handled whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
HASH_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RNG = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BYTE[IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system, as workers stay for later stages; where the C library can't, what Arrow holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` text bytes; one longer document stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and, from 0, where each row begins and ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and how many come before each row (with the total at the end); `between` marks the bytes that are in no word."""
    word = ~between[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + HASH_BYTES)))
        low, high = start[i], end[j - 1]
        place = np.arange(low, high)
        place -= np.repeat(start[i:j], np.diff(np.append(start[i:j], high)))
        power = np.full(int(place.max()) + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        out[i:j] = np.add.reduceat(_BYTE[data[low:high]] * power[place], start[i:j] - low)
        i = j
    return mix(out + (end - start).astype(np.uint64))


def ngrams(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each n consecutive words of a row, and how many come before each row."""
    counts = np.maximum(np.diff(before) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    length = len(hashes) - n + 1
    total = np.zeros(length, np.uint64)
    for k in range(n):
        total += hashes[k : k + length] * _ORDER[k]
    where = np.repeat(before[:-1] - out[:-1], counts) + np.arange(out[-1])
    return mix(total[where]), out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for `length[0]` places, then the next range."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins and ends there."""
    length = end - start
    out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    to = np.cumsum(length + 1) - (length + 1)
    out[ranges(to, length)] = data[ranges(start, length)]
    return out.tobytes(), to, to + length


def text_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as a text column."""
    length = end - start
    own = data[ranges(start, length)]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(own.tobytes())])
