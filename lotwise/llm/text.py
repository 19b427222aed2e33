"""Vectorised text kernels over Arrow string columns: words, 64-bit word hashes and n-gram hashes.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. These bytes occur in no multi-byte UTF-8
sequence, so that the rule on bytes and the rule on characters give the same words. All hashes are wrapping 64-bit
polynomials over random tables with a final mix, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[_SPACE] = 0
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD1342543DE82EF95)
_powers = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 4096), _BASE, U64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after the other, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer row stands alone."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Words:
    """The words of a chunk: byte ranges ``starts`` to ``ends``, ``row`` of each, and ``first`` word of each row."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        space = _SPACE[data]
        edge = np.ones(len(data) + 1, bool)  # a word also ends where its row ends
        edge[1:-1] = space[1:] != space[:-1]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        word = ~space
        begins = np.empty(len(data), bool)
        begins[:1] = word[:1]
        begins[1:] = word[1:] & (space[:-1] | cut[1:-1])
        stops = np.empty(len(data), bool)
        stops[-1:] = word[-1:]
        stops[:-1] = word[:-1] & (space[1:] | cut[1:-1])
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, U64)
        n = self.ends - self.starts
        inside = np.arange(len(self.data), dtype=np.int32)
        shift = np.zeros(len(self.data), np.int32)
        shift[self.starts] = np.diff(self.starts, prepend=0)
        inside -= np.cumsum(shift, dtype=np.int32)
        np.maximum(inside, 0, out=inside)
        terms = _BYTE[self.data]
        terms *= powers_to(int(inside.max()) + 1)[inside]
        return mix(np.add.reduceat(terms, self.starts) ^ n.astype(U64))

    def gram_ok(self, n: int) -> np.ndarray:
        """True at each word at which n words of its row begin; len(self) - n + 1 entries."""
        return self.row[n - 1 :] == self.row[: max(0, len(self) - n + 1)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive entries of h, in order; rows aren't told apart here."""
    if len(h) < n:
        return np.zeros(0, U64)
    count, size = len(h) - n + 1, 1
    power, step, done, out = h, _STEP, 0, np.zeros(count, U64)
    scale = U64(1)
    with np.errstate(over="ignore"):
        while size <= n:
            if n & size:
                out += scale * power[done : done + count]
                done += size
                scale = scale * step
            if size * 2 <= n:
                power = power[: len(power) - size] + step * power[size:]
            step = step * step
            size *= 2
    return mix(out ^ U64(n))


_inverse = pow(int(_STEP), -1, 1 << 64)
_steps = _back = np.ones(1, U64)


class Spans:
    """Hashes of arbitrary ranges of consecutive words, from prefix sums of one chunk's word hashes."""

    def __init__(self, h: np.ndarray, salt: int = 0):
        global _steps, _back
        if len(_steps) < len(h) + 1:
            n = max(len(h) + 1, 1 << 16)
            _steps, _back = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, s, U64)])) for s in (_STEP, U64(_inverse)))
        h = mix(h + U64(salt)) if salt else h
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * _steps[: len(h)], dtype=U64)])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the words a to b - 1."""
        return mix((self.sums[b] - self.sums[a]) * _back[a] ^ mix((b - a).astype(U64)))


def sliding(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """The least (or greatest) of each n consecutive entries; len(x) - n + 1 entries."""
    if len(x) < n:
        return x[:0]
    size = 1
    while size * 2 <= n:
        x = best(x[: len(x) - size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if size < n else x
