"""Words of many texts at once: hashes by prefix sums over the bytes of an Arrow buffer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd base, and 256 random values for the bytes.
BASE = 0x9E3779B97F4A7C15
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KINDS = (~SPACE).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of each range of bytes, by prefix sums."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(base, len(data)), dtype=np.uint64)])
    back = powers(pow(base, -1, 2**64), len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each of the ranges, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row's start and the last one's end; null has none."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"") if column.null_count else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of such bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Words:
    """Words of rows, in order: 64-bit hashes, byte ranges in ``data`` and the bounds of each row's words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # row i has words bounds[i]:bounds[i+1]
    data: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a row, the place of each one's first word, and the bounds by row."""
        count = np.maximum(np.diff(self.bounds) - n + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(count)])
        first = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], count)
        total = np.zeros(len(first), np.uint64)
        for j in range(n):
            total = total * np.uint64(BASE) + self.hashes[first + j]
        return mix(total), first, bounds


def words(column: pa.Array, lower: bool = False, kinds: np.ndarray = KINDS, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column; null has none. ``lower``: A-Z count as a-z.

    ``kinds``: another class for each byte; a word is a longest run of bytes of one class above 0.
    ``change``: is applied to all bytes first and keeps their number.
    """
    data, offsets = content(column.cast(pa.string()) if not pa.types.is_string(column.type) else column)
    if lower:
        data = LOWER[data]
    if change is not None:
        data = change(data)
    kind = kinds[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    starts = np.flatnonzero((kind > 0) & edge[:-1])
    ends = np.flatnonzero((kind > 0) & edge[1:]) + 1
    return Words(span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets), data)
