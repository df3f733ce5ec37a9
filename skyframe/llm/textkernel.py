"""Vectorised word arithmetic over Arrow string buffers.

An Arrow string column is one byte buffer with offsets. The functions here find words, lines and n-grams of many
documents at once with numpy and identify each by a 64-bit hash, so no Python object is made for a word. Memory is
bounded by :data:`CHUNK_BYTES` or the longest single document, whichever is greater.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents are handled together up to this many bytes.
CHUNK_BYTES = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15 | 5)
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that hashes made by sums spread over all 64 bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _U64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


BYTE_VALUES = {False: _byte_values(False), True: _byte_values(True)}
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.n = base, 0
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK_BYTES + 1)
            self.up, self.down = self._run(int(self.base)), self._run(_inverse(int(self.base)))
        return self.up[:n], self.down[:n]

    def _run(self, base: int) -> np.ndarray:
        out = np.full(self.n, _U64(base))
        out[0] = _U64(1)
        return np.multiply.accumulate(out)


_BYTES, _WORDS = _Powers(_MULT), _Powers(_U64(0xC2B2AE3D27D4EB4F | 5))


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hashes of ``values[start:end]`` that depend on the contents only."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U64(0xA0761D6478BD642F))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about CHUNK_BYTES; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """The words of a chunk: byte ``starts`` and ``ends``, and ``bounds``: document d has words bounds[d]:bounds[d+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~IS_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.ones(len(data) + 1, bool)
        before[1:] = ~inside
        before |= cut
        after = np.ones(len(data) + 1, bool)
        after[:-1] = ~inside
        after |= cut
        self.starts = np.flatnonzero(inside & before[:-1])
        self.ends = np.flatnonzero(inside & after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return _range_hashes(BYTE_VALUES[lower][self.data], self.starts, self.ends, _BYTES)


def byte_range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _range_hashes(BYTE_VALUES[False][data], starts, ends, _BYTES)


def word_range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, by word index."""
    return _range_hashes(words, starts, ends, _WORDS)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each index on; the last n - 1 indexes have none."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, _ = _WORDS.get(n + 1)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(out) + k] * up[k + 1]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
