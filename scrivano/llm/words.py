"""Words and their 64-bit hashes, vectorised over the bytes of an Arrow string column.

A word is a run of bytes other than space and \\x09-\\x0D; words never cross texts. Hashes are
polynomials modulo 2**64 over random byte values, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Letters, digits and all bytes of other scripts make words; every other byte parts them.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) | np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _power[i] = np.cumprod(steps, dtype=np.uint64)
    return _power[0], _power[1]


def give_back() -> None:
    """Return what a task no longer needs to the system, as Python workers outlive their tasks."""
    _power[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries offer it
        pass


def tidy(run):
    """The task function ``run``, giving back at its end."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the number of words before it (one more at the end)."""
    solid = ~between[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = solid[edge]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """One hash per word; ``fold`` takes A-Z as a-z."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUES)[data] * power[: len(data)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))
