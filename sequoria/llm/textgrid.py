"""Numpy helpers shared by the Arrow operators: texts of a batch as one byte array.

All of them work on chunks of whole texts (about a megabyte, or one longer text), so
memory follows the chunk, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))

#: Byte is not one of space, \t, \n, \v, \f, \r.
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Byte begins a code point.
LEAD_BYTE = (np.arange(256) & 0xC0) != 0x80

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; grown by doubling and kept for the process."""
    global _powers
    up, down = _powers
    while len(up) < n:
        k = len(up)
        up = np.concatenate([up, up * np.uint64(pow(int(BASE), k, 2**64))])
        down = np.concatenate([down, down * np.uint64(pow(int(BASE_INV), k, 2**64))])
    if len(up) <= 1 << 22:
        _powers = up, down
    return up, down


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer; another seed gives another order of the same values."""
    x = x ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash``; one longer than values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[begin:end] that does not depend on where the span lies."""
    return (prefix[end] - prefix[begin]) * powers(len(prefix))[1][begin]


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def runs_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross texts: (begin, end, first run of each text and the total)."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    begin = np.flatnonzero(mask & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = mask[1:]
    end = np.flatnonzero(mask & (~after | first[1:])) + 1
    return begin, end, np.searchsorted(begin, offsets)


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs twice or more."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def covered(begin: np.ndarray, length: int, n: int) -> np.ndarray:
    """Of n positions, those inside [b, b + length) for some b."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, np.minimum(begin + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each [offsets[i], offsets[i + 1])."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
