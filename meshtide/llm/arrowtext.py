"""Vectorised text primitives over Arrow batches: bounded slices, words, hashes.

Everything works on the UTF-8 bytes of a batch at once. The white space that
separates words is ``[\\x20\\x09-\\x0D]``; any other byte belongs to a word, so
multi-byte characters are never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at a time; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Odd constants that join two hashes; one set a lane.
JOIN = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)))


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each slice holds about ``max_bytes`` of text, one row at least."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
            ends = offsets_of(column)[1:] - offsets_of(column)[0]
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
                yield batch.slice(at, to - at)
                at = to
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on, and the next operator's need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than it has rows."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and each row's offset in them; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    at = offsets_of(column)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z made lower case."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one more than rows)."""
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    after[at[1:][at[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coded_words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each token's word, each row's first token, the bytes and the tokens' spans in them; lower: A to Z in lower case."""
    data, at = utf8(column)
    if lower:
        data = ascii_lower(data)
    starts, ends, first = word_spans(data, at)
    coded = binaries(*gather(data, starts, ends)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), first, data, starts, ends


def digests(words: pa.Array) -> np.ndarray:
    """128 bits of hash (XXH3) of each word's bytes, as two columns of 64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), "<u8").reshape(-1, 2)


def joined(x: np.ndarray, y: np.ndarray, lane: int) -> np.ndarray:
    """A hash of two hashes, in order."""
    p, q = JOIN[lane]
    return mix(x * p + (y << np.uint64(32) | y >> np.uint64(32)) * q)


def window_hashes(words: np.ndarray, window: int, lane: int) -> np.ndarray:
    """A hash of each ``window`` consecutive hashes, built like a tree: halves are joined, their halves before them."""
    level, size, out, done, rest = words, 1, None, 0, window
    while rest:
        if rest & 1:
            own = level[done:]
            out = own if out is None else joined(out[: len(own)], own[: len(out)], lane)
            done += size
        rest >>= 1
        if rest:
            level = joined(level[: max(0, len(level) - size)], level[size:], lane)
            size *= 2
    return out[: max(0, len(words) - window + 1)]


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans laid end to end, and the offsets of each."""
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return data[np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)], at


def spaced_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words laid end to end with one space after each, and their new spans."""
    lengths = ends - starts + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    if not len(starts):
        return np.zeros(0, np.uint8), at[:-1], at[:-1]
    source = np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)
    out = data[np.minimum(source, len(data) - 1)]
    out[at[1:] - 1] = 0x20
    return out, at[:-1], at[1:] - 1


def binaries(data: np.ndarray, at: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow binary (or string) array over bytes and offsets, without a copy of the bytes."""
    return pa.Array.from_buffers(kind or pa.binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
