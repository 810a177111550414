"""Terms of a chunk of texts as numbers, for operators that count them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sequoria.llm import textgrid as g

CHUNK_BYTES = 1 << 24


def alphabet(digits: bool) -> bytes:
    """A byte table: A-Z to a-z; a-z, bytes from 0x80 and (on request) digits stay; other bytes become spaces."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or digits and 48 <= b <= 57 else 32 for b in range(256))


def split_terms(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each term, its code, the terms by code) of a column of texts; null counts as empty."""
    data, offsets = g.texts_of(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes().translate(table)))
    parts = pc.split_pattern(plain, " ")
    counts = np.diff(parts.offsets.to_numpy())
    found, rows = parts.flatten(), np.repeat(np.arange(len(texts)), counts)
    full = pc.greater(pc.binary_length(found), 0)
    distinct = found.filter(full).dictionary_encode()
    return rows[full.to_numpy(zero_copy_only=False)], distinct.indices.to_numpy(), distinct.dictionary


def gathered_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in chunks of about ``limit`` bytes of text and at most ``rows`` rows, or one row."""
    held, size, n = [], 0, 0
    for batch in batches:
        for wide in g.chunks(batch, text, limit):
            for at in range(0, wide.num_rows, rows):
                part = wide.slice(at, rows)
                bytes_ = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
                if held and (size + bytes_ > limit or n + part.num_rows > rows):
                    yield _one(held)
                    held, size, n = [], 0, 0
                held.append(part)
                size, n = size + bytes_, n + part.num_rows
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
