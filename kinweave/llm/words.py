"""Vectorised splitting of Arrow text columns into hashed words.

White space is exactly the six characters ``[\\x20\\x09-\\x0D]``; only A-Z are folded to lower case.
All functions take whole Arrow buffers, so the cost per word is a few dozen nanoseconds.
Hashes are 64 bits and depend on nothing but the bytes of the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 2 << 20
_LONG_WORD = 256

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[list(SPACE)] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; one longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at the end)."""
    solid = _NOT_SPACE[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[heads] = solid[heads]
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; words of up to eight bytes and one length never share one. Other seeds give other hashes."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    out = (eight[starts] & _MASK[np.minimum(size, 8)]) + (size.astype(np.uint64) << np.uint64(56)) + np.uint64(seed)
    out = mix(out)
    rest = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    at = 8
    while len(rest):
        part = eight[starts[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]
        out[rest] = mix(out[rest] ^ part) + np.uint64(at)
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def hashed_words(column, fold: bool, limit: int = BLOCK_BYTES):
    """For each block of rows: (first row, row word index, word hashes, starts, ends, bytes)."""
    data, offsets = text_buffer(column)
    for i, j in blocks(offsets, limit):
        part = data[offsets[i] : offsets[j]]
        if fold:
            part = FOLD[part]
        own = offsets[i : j + 1] - offsets[i]
        starts, ends, index = word_bounds(part, own)
        yield i, index, word_hashes(part, starts, ends), starts, ends, part


def odd_powers(n: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)

    def run(b: int) -> np.ndarray:
        out = np.ones(max(n, 1), np.uint64)
        out[1:] = np.uint64(b)
        return np.multiply.accumulate(out)

    return run(base), run(inverse)


class Grams:
    """Hashes of k consecutive words from prefix sums: any k in constant time per position."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = odd_powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=self.sums[1:])

    def of(self, at: np.ndarray, k) -> np.ndarray:
        return mix((self.sums[at + k] - self.sums[at]) * self.down[at])


def plain(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) if isinstance(c, np.ndarray) else c for c in columns], names)
