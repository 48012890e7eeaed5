"""Vectorised word hashing over Arrow text buffers, shared by the operators that work on word sequences.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Its hash is a polynomial over
random 64-bit values of its bytes, finalised by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from framequill.session import ship, tidy

ship(__name__)

SPACES = (32, 9, 10, 11, 12, 13)
PIECE = 1 << 20


def byte_values() -> np.ndarray:
    table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table[65:91] = table[97:123]
    table[list(SPACES)] = 0
    return table


BYTES = byte_values()
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of each; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more than texts)."""
    out, counts = [], np.zeros(len(offsets), np.int64)
    at, n = 0, len(data)
    ends = np.zeros(n + 1, bool)
    ends[offsets] = True
    while at < n:
        to = min(n, at + PIECE)
        while to < n:  # cut at a space or between texts, never in a word
            free = np.flatnonzero((BYTES[data[to : to + PIECE]] == 0) | ends[to : min(n, to + PIECE)])
            to = to + int(free[0]) if len(free) else min(n, to + PIECE)
            if len(free):
                break
        values = BYTES[data[at:to]]
        black = values != 0
        first = black.copy()
        first[1:] &= ~black[:-1] | ends[at + 1 : to]
        starts = np.flatnonzero(first)
        if len(starts):
            length = np.diff(np.append(starts, to - at))
            values = values[starts[0] :]
            values *= powers(int(length.max()))[np.arange(len(values)) - np.repeat(starts - starts[0], length)]
            out.append(mix(np.add.reduceat(values, starts - starts[0])))
            counts += np.searchsorted(starts + at, offsets)
        at = to
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece have about ``most`` bytes together."""
    try:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)))
            group = np.cumsum(np.asarray(lengths.fill_null(0), dtype=np.int64)) // most
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else []
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)
    finally:
        tidy()
