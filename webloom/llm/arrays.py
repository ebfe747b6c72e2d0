"""Whole texts as flat byte arrays: words, lines and their hashes for a batch of rows at once.

All functions take ``data`` (the UTF-8 bytes of many texts, one after the other) and ``offsets``
(where each text begins, and the end). Nothing here knows Spark: these are the per-batch helpers
of the Arrow functions in this folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)


def byte_class(*members: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACE = byte_class(0x20, *range(0x09, 0x0E))
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
HEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, values = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0]:offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows with at most ``limit`` bytes of text each, or one longer row."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(name)))
    low, rows = 0, batch.num_rows
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low), data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes; no run crosses from one text to the next."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    follows = np.zeros(n + 1, bool)
    follows[1:] = inside
    here = np.zeros(n + 1, bool)
    here[:-1] = inside
    return np.flatnonzero(here & (edge | ~follows)), np.flatnonzero(follows & (edge | ~here))


def by_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For sorted positions: index of the first one of each text, and the number of all."""
    return np.searchsorted(starts, offsets, "left")


LONG_RANGE = 4096


def strong(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes after the other, each mixed in before the next.

    Unlike a polynomial it has no algebra by which ranges of some form must collide. Long ranges take XXH3.
    """
    from xxhash import xxh3_64_intdigest

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    value = mix(left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x94D049BB133111EB))
    long_ = np.flatnonzero(left > LONG_RANGE)
    for i in long_.tolist():
        value[i] = xxh3_64_intdigest(memoryview(padded)[starts[i]:ends[i]])
    who = np.flatnonzero((left > 0) & (left <= LONG_RANGE))
    at, left = starts[who], left[who]
    while len(who):
        part = eight[at] & (np.uint64(MASK) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        value[who] = mix(value[who] * np.uint64(0x2545F4914F6CDD1D) + part)
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    return value


def names128(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit names of byte ranges, as rows of two 64-bit numbers."""
    from xxhash import xxh3_128_digest

    raw = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join(xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64).reshape(-1, 2)


class Hasher:
    """Polynomial hashes of any byte ranges of one flat array, in constant time each.

    They choose places (triggers, k-grams); strings that collide by design cost time there. Whether ranges are equal is
    for ``strong`` and ``names128`` to tell.
    """

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * self._powers[:len(data)], out=self.sums[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            size = max(n, 1 << 20)
            for name, base in (("_powers", BASE), ("_inverse", INVERSE)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self._inverse[starts]
        return mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def every(self, width: int) -> np.ndarray:
        """The hashes that ``of`` gives, of all ranges of ``width`` bytes in order."""
        n = max(len(self.sums) - width, 0)
        value = (self.sums[width:] - self.sums[:n]) * self._inverse[:n]
        return mix(value ^ np.uint64(width * 0xD6E8FEB86659FD93 & MASK))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + values[k:k + n])
    return total


def totals(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each text."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
