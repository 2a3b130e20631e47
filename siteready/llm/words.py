"""Words of whole texts as numpy arrays, for functions that run inside Spark tasks.

A word is a run of bytes outside space and 0x09-0x0D; A-Z are lower-cased first and nothing else changes. Words are
named by 64-bit hashes of their bytes; everything is computed a slice of documents at a time, so a task's memory
follows ``SLICE_BYTES`` and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once.
SLICE_BYTES = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 0)
_INV = _POW
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) <= n:
        _POW, _INV = _powers(_BASE, n + n // 4), _powers(_BASE_INV, n + n // 4)
    return _POW, _INV


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; data holds bytes."""
    pow_, inv = _grown(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * pow_[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column that hold about ``limit`` bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column's rows, a space after each row; and where each row starts, with the end last."""
    column = pc.fill_null(column, "") if column.null_count else column
    parts = column.to_pylist()
    joined = " ".join(parts).encode() + b" "
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=bounds[1:])
    return np.frombuffer(joined if parts else b"", np.uint8), bounds


class Words:
    """The lower-cased words of a slice: hashes, byte bounds, and each row's first word with the end last."""

    def __init__(self, column: pa.Array):
        data, bounds = text_bytes(column)
        self.data = _LOWER[data]
        gap = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = run_hashes(self.data, self.starts, self.ends)
        self.rows = np.searchsorted(self.starts, bounds)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; of the whole text as one run if it has fewer words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(n, width)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total = mix(total + hashes[i: n - k + 1 + i] + np.uint64(i + 1))
    return mix(total + np.uint64(k))
