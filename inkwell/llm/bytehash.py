"""Vectorised hashing of words and byte windows over blocks of whole texts (numpy, no loop over words).

A block is a run of documents laid end to end as bytes. Every byte has a random 64-bit value; the hash of
bytes [a, b) is the difference of two prefix sums of ``value * B**position`` moved back to position 0, then
mixed. Documents that are longer than a block form a block of their own: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd base of the prefix sums and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def mapped(step):
    """A function for ``mapInArrow`` that leaves no Arrow buffers behind in its worker, which is kept between tasks."""

    def run(batches):
        yield from step(batches)
        pa.default_memory_pool().release_unused()

    return run


def grouped(step):
    """A function for ``applyInArrow`` that leaves no Arrow buffers behind in its worker."""

    def run(table: pa.Table) -> pa.Table:
        out = step(table)
        pa.default_memory_pool().release_unused()
        return out

    return run


def cogrouped(step):
    """The same of two cogrouped tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = step(left, right)
        pa.default_memory_pool().release_unused()
        return out

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(BASE))


@lru_cache(maxsize=4)
def _byte_values(seed: int = 11) -> np.ndarray:
    return stream(seed, 256) | U64(1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept, and doubled when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 20, int(n) + 1)
        have = np.full(size + 1, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[: n + 1]


def prefix(data: np.ndarray, seed: int = 11) -> np.ndarray:
    """Prefix sums of the block, one longer than the block; hashes of different seeds are independent."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_byte_values(seed)[data] * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def prefix_of(values: np.ndarray) -> np.ndarray:
    """Prefix sums as of ``prefix``, over 64-bit values instead of bytes."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(BASE, len(values))[: len(values)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) for arrays of spans: equal for equal strings wherever they stand."""
    inv = powers(BASE_INV, len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hash(pre: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` bytes of the block, windows over two documents included."""
    n = len(pre) - size
    if n <= 0:
        return np.zeros(0, dtype=U64)
    inv = powers(BASE_INV, len(pre))
    return mix((pre[size:] - pre[:n]) * inv[:n] + U64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


class Block:
    """Documents laid end to end: ``ids``, ``data`` (bytes) and ``offs`` (document i is data[offs[i]:offs[i+1]])."""

    __slots__ = ("data", "first", "ids", "offs")

    def __init__(self, ids: np.ndarray, data: np.ndarray, offs: np.ndarray, first: int = 0):
        self.ids, self.data, self.offs, self.first = ids, data, offs, first

    def __len__(self) -> int:
        return len(self.ids)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, nulls as empty texts."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offs, raw


def blocks(batches: Iterable[pa.RecordBatch], most: int = 1 << 18, ids: int = 0, text: int = 1) -> Iterator[Block]:
    """Blocks of about ``most`` bytes; a longer document is a block alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offs, raw = string_buffers(batch.column(text))
        keys = batch.column(ids).to_numpy(zero_copy_only=False)
        i = 0
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
            j = min(j, len(keys))
            yield Block(keys[i:j], raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
            i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Letters and digits of ASCII and all bytes of other characters.
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def column_blocks(column: pa.Array, most: int = 1 << 18) -> Iterator[Block]:
    """Blocks of one string column; ``ids`` are the row numbers."""
    return blocks([pa.RecordBatch.from_arrays([pa.array(np.arange(len(column))), column], names=["id", "text"])], most)


class Words:
    """The words of a block: ``start`` and ``end`` in bytes, ``hash``, and ``offs`` (words of document i)."""

    __slots__ = ("end", "hash", "offs", "start")

    def __init__(self, block: Block, kind: str = "space", hashed: bool = True):
        data = _LOWER[block.data]
        inside = (_NOT_SPACE if kind == "space" else _ALNUM)[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[block.offs] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[n - 1 :] = False
        after[: n - 1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.offs = np.searchsorted(self.start, block.offs)
        self.hash = span_hash(prefix(data), self.start, self.end) if hashed else None


#: Multipliers of the places of a word in a shingle.
_PLACES = stream(23, 64) | U64(1)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, in text order, and their offsets by document.

    A document with fewer words has one shingle, its whole sequence; one without words has none.
    """
    count = np.diff(words.offs)
    per = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    offs = np.concatenate(([0], np.cumsum(per)))
    n = len(words.hash)
    runs = np.zeros(max(n - size + 1, 0), dtype=U64)
    for j in range(size):
        runs += words.hash[j : n - size + 1 + j] * _PLACES[j] if n >= size else U64(0)
    total = int(offs[-1])
    doc = np.repeat(np.arange(len(per)), per)
    place = np.arange(total) - offs[doc] + words.offs[doc]
    out = np.zeros(total, dtype=U64)
    whole = count[doc] >= size
    out[whole] = runs[place[whole]]
    for i in np.flatnonzero((count > 0) & (count < size)):
        a, b = words.offs[i], words.offs[i + 1]
        out[offs[i]] = np.sum(np.append(words.hash[a:b] * _PLACES[: b - a], U64(int(b - a) * 0xA24BAED4963EE407 & (1 << 64) - 1)), dtype=U64)
    return mix(out), offs


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    out = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=U64)), out
