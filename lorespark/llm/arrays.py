"""Texts as flat numpy arrays inside one task: bytes, words and their hashes.

All helpers take Arrow columns and work on slices of bounded size. A word never
crosses the end of its row. A null text is an empty text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that one slice holds; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 17

_GENERATOR = np.random.default_rng(20240229)
_BYTE_VALUES = _GENERATOR.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def bounded_batches(spark: SparkSession, megabytes: int = 2) -> None:
    """Bound Arrow batches by bytes, not only by rows: very long texts come in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


_model: dict = {}


def kept_model(key, build):
    """The model of a worker, built once: workers serve many tasks, and keep the last model they were asked for."""
    if key not in _model:
        drop_model()
        _model[key] = build()
    return _model[key]


def drop_model() -> None:
    """Give the memory of a model and of earlier tasks back to the machine; operators without a model begin with this."""
    if _model:
        _model.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows with at most `limit` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


#: A prime, and two of its primitive roots: runs are polynomials at both, which no regular text makes equal.
_PRIME = np.uint64(2**31 - 1)
_ROOTS = (1103515245, 48271)
_LOW, _HIGH = np.uint64(31), np.uint64(33)


def _fold(values: np.ndarray) -> np.ndarray:
    """Make values smaller in place, without a change modulo the prime: below 2**33 + 2**31."""
    above = values >> _LOW
    values &= _PRIME
    values += above
    return values


class _Powers:
    """Powers of a root modulo the prime and of its inverse, grown on demand."""

    def __init__(self, root: int) -> None:
        self.root = root
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        prime = int(_PRIME)
        while len(self.up) < size:
            step = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.root, step, prime)) % _PRIME])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.root, -step, prime)) % _PRIME])
        return self.up, self.down


@cache
def _powers(root: int) -> _Powers:
    return _Powers(root)


def range_hashes(values: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, size: int | None = None) -> np.ndarray:
    """A hash of each run values[start:end], 62 bits spread over 64; equal runs anywhere have equal hashes.

    Two polynomials modulo a prime, one of the low and one of the high bits of the
    values. `size` is the length of all runs where starts and ends are slices.
    """
    whole = np.zeros(1, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    for root, part in zip(_ROOTS, (values & _PRIME, values >> _HIGH)):
        up, down = _powers(root).upto(len(values) + 1)
        part *= up[: len(values)]
        np.cumsum(_fold(part), out=sums[1:])
        run = sums[ends] - sums[starts]
        _fold(_fold(run))
        run *= down[starts]
        _fold(_fold(run))
        run[run >= _PRIME] -= _PRIME
        whole = whole << _LOW | run
    hashes = mix(whole)
    hashes += np.uint64(size) if size is not None else (ends - starts).astype(np.uint64)
    return mix(hashes)


def byte_values(data: np.ndarray) -> np.ndarray:
    """Bytes as 64-bit values for `range_hashes`."""
    return _BYTE_VALUES[data]


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` values."""
    if len(values) < size:
        return np.empty(0, np.uint64)
    count = len(values) - size + 1
    return range_hashes(values, slice(0, count), slice(size, size + count), size)


def class_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte to lower-cased byte (A-Z only), 0 for separators. Byte 0 must be a separator or is mapped to 1."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 1
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words are runs of anything but blanks.
SPACED = bytes([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, letters a-z and non-ASCII characters (after lower-casing).
SIGNS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def word_spans(mapped: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row and in all) of the words in mapped bytes."""
    inside = np.zeros(len(mapped) + 2, np.bool_)
    inside[1:-1] = mapped != 0
    first = np.zeros(len(mapped) + 1, np.bool_)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, offsets)


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash (the last of equals) of some run of `window` hashes.

    A list shorter than the window gives its least place, so nothing non-empty stays without one.
    """
    if not len(hashes):
        return np.empty(0, np.int64)
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    # Least of every window by doubling; ties are broken by the place.
    size, least = 1, np.arange(len(hashes))
    while size < window:
        step = min(size, window - size)
        left, right = least[: len(least) - step], least[step:]
        least = np.where(hashes[right] <= hashes[left], right, left)
        size += step
    return np.unique(least)


#: Bits of a packed value that hold a place; the hash keeps the others, alike for every text.
_PLACE_BITS = 28
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)


def window_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every run of `window` hashes the place of its least one (the first of equals)."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    limit = (1 << _PLACE_BITS) - 1
    if len(hashes) > limit:
        left = window_anchors(hashes[:limit], window)
        return np.concatenate([left, window_anchors(hashes[len(left) :], window) + len(left)])
    least = (hashes & ~_PLACES) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size < window:
        step = min(size, window - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    return (least & _PLACES).astype(np.int64)
