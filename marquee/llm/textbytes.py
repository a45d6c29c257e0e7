"""Words and rolling hashes of many texts at once, on the bytes of an Arrow column.

Everything here is a bounded numpy helper for one Arrow batch inside a Spark task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from marquee.llm import worker

# Odd, so that powers can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 19
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offset of each text; null is empty.

    Tables that another operator left in this worker go first.
    """
    worker.release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = column.type in (pa.large_string(), pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if column.type in (pa.string(), pa.large_string()) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if data is None or last == first:
        return np.zeros(0, np.uint8), offsets - first
    return np.frombuffer(data, np.uint8)[first:last], offsets - first


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        if n:
            p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits; `h` is overwritten."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Hash sums of all prefixes; data[i:j] hashes to (sums[j] - sums[i]) * BASE**-i."""
    up, _ = powers(_room(len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def _room(n: int) -> int:
    room = CHUNK + 4096
    while room < n + 1:
        room *= 2
    return room


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every data[start:end]."""
    sums = prefix_hash(data)
    _, down = powers(_room(len(data)))
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hash(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every substring of `width` bytes, in order of its start."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    _, down = powers(_room(len(data)))
    return mix((sums[width:] - sums[:n]) * down[:n])


def byte_table(words: bytes | None = None, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is the byte part of a word, byte to hash): all but blanks, or the named bytes."""
    member = np.ones(256, bool)
    if words is None:
        member[list(BLANKS)] = False
    else:
        member[:] = False
        member[list(words)] = True
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[ord("A") : ord("Z") + 1] += 32
    return member, to


def document_blocks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes; a longer document is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words_of(
    data: np.ndarray, offsets: np.ndarray, member: np.ndarray, to: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of every word; a word is a maximal run of member bytes."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lengths = np.diff(offsets)
    heads = offsets[:-1][lengths > 0]
    tails = offsets[1:][lengths > 0] - 1
    begins[heads] = inside[heads]
    ends[tails] = inside[tails]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = span_hash(to[data], starts, stops)
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def word_sequences(
    data: np.ndarray, offsets: np.ndarray, member: np.ndarray, to: np.ndarray
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of documents: first, last, word hashes, document number within the block."""
    for first, last in document_blocks(offsets):
        low, high = int(offsets[first]), int(offsets[last])
        hashes, docs = words_of(data[low:high], offsets[first : last + 1] - low, member, to)
        yield first, last, hashes, docs


def join_words(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of word tuples, given as one array of word hashes per position."""
    out = np.full(len(parts[0]), 0x51ED270B35A1D6C5, np.uint64)
    for part in parts:
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += part
        out ^= out >> np.uint64(32)
    return mix(out)
