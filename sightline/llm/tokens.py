"""Words of Arrow text columns as numpy arrays: vectorised splitting, hashing and rolling hashes.

Texts are read in chunks of about ``CHUNK`` bytes, so that the arrays of one chunk stay small however many rows an Arrow
batch has. Every text is read whole; a text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def whitespace_table() -> np.ndarray:
    """Bytes kept as they are; space and 0x09-0x0D separate words."""
    table = np.arange(256, dtype=np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def letter_table(digits: bool = True) -> np.ndarray:
    """ASCII letters (lower-cased), digits if wanted and all bytes of other characters; all else separates words."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    if digits:
        table[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values; k - 1 results fewer than values."""
    n = len(values)
    if n < k:
        return np.zeros(0, U64)
    up, down = _POWERS.get(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


class Chunk(NamedTuple):
    """Texts ``first`` to ``first + n - 1`` of a column: their bytes and the bounds of each."""

    first: int
    n: int
    data: np.ndarray
    bounds: np.ndarray


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Consecutive texts of a string column, about ``size`` bytes at a time. A null text is an empty one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Chunk(at, to - at, body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class Words(NamedTuple):
    """Words of a chunk in order: byte bounds, 64-bit hash, text (index in the chunk) and first word of each text."""

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    text: np.ndarray
    first: np.ndarray  # one more than texts


def words(chunk: Chunk, table: np.ndarray) -> Words:
    """Maximal runs of bytes that ``table`` maps to other than 0, hashed as mapped."""
    mapped = table[chunk.data]
    n = len(mapped)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), none, np.zeros(chunk.n + 1, np.int64))
    inside = mapped != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = chunk.bounds[:-1]
    heads = heads[heads < n]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = chunk.bounds[1:] - 1
    tails = tails[tails >= 0]
    closes[tails] = inside[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _POWERS.get(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(mapped * up, out=total[1:])
    code = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    first = np.searchsorted(start, chunk.bounds)
    return Words(start, end, code, np.repeat(np.arange(chunk.n), np.diff(first)), first)


def word_code(word: str, table: np.ndarray) -> int:
    """Hash that ``words`` gives to a single word."""
    found = words(Chunk(0, 1, np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())])), table)
    return int(found.code[0]) if len(found.code) else 0


def lookup(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each code in the sorted ``keys``, or -1."""
    if len(keys) == 0 or len(codes) == 0:
        return np.full(len(codes), -1, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> U64(44)).astype(np.int64)] = True
    out = np.full(len(codes), -1, np.int64)
    some = np.flatnonzero(seen[(codes >> U64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, codes[some]), len(keys) - 1)
    hit = keys[at] == codes[some]
    out[some[hit]] = at[hit]
    return out
