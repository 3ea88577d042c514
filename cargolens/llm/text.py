"""Vectorised text helpers for functions that run inside tasks (numpy over Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step looks at; it bounds a task's working memory.
STEP_BYTES = 2 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = max(start + 1, min(end, batch.num_rows))
            yield batch.slice(start, end - start)
            start = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins; null counts as empty."""
    array = array.fill_null("") if array.null_count else array
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(members: Iterable[int]) -> np.ndarray:
    """A table of 256 flags."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~byte_table([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Lower case for A-Z, every other byte as it is.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
LOWER = LOWER.astype(np.uint8)


def runs(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """Maximal runs of bytes with ``member[byte]`` inside each text: starts, ends, text numbers."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < len(buf)]
    first[begins] = inside[begins]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64; grown by doubling and kept for the worker's life."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, _BASE if which == "base" else _INVERSE, U64)
        have[0] = 1
        _powers[which] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambling (xor-shift and multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the value sequence of each span: equal sequences, equal hashes, anywhere."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power("base", len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("inverse", len(values) + 1)[starts])


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    return span_sums(_BYTE_VALUES[buf], starts, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; windows that cross texts are the caller's to drop."""
    n = max(0, len(words) - size + 1)
    at = np.arange(n)
    return span_sums(words, at, at + size)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return x.view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)])
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def char_positions(buf: np.ndarray) -> np.ndarray:
    """For each byte place, and the end, how many code points begin before it."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
