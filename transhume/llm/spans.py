"""Words and pieces of a batch of texts as positions in its bytes, hashed without a loop over them.

A batch arrives as one Arrow column: the texts' bytes end to end, with the place where each starts.
Hashes are 64-bit polynomials over a table of random byte values, taken from running sums, so that a
byte costs a few array operations however short the words are.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once, and bytes of a batch worked on at once.
SEGMENT = 1 << 19
AT_ONCE = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Space, tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on batches, which at its end gives the memory it has freed back to the system: the
    process lives on between tasks and would keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def slices(column: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of texts; a null text is empty.

    A run has at most `at_once` bytes, or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    rows = len(column)
    if not rows:
        return
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = int(np.searchsorted(bounds, bounds[lo] + at_once, side="right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi, whole[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of all texts, and the number of each text's first word."""
    solid = ~BLANKS[data]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = inner[inner > 0] - 1
    closes[last] = solid[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds)


class Hasher:
    """Hashes spans of bytes.  With fold, A to Z count as a to z."""

    def __init__(self, fold: bool = False, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
        if fold:
            self.table[ord("A") : ord("Z") + 1] = self.table[ord("a") : ord("z") + 1]
        self.reach(SEGMENT)

    def reach(self, n: int) -> None:
        back = pow(_BASE, -1, 1 << 64)
        self.up, self.down = (
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64)
            for x in (_BASE, back)
        )

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            base = starts[a]
            b = max(int(np.searchsorted(ends, base + SEGMENT, side="right")), a + 1)
            n = int(ends[b - 1] - base)
            if n >= len(self.up):
                self.reach(2 * n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.table[data[base : base + n]] * self.up[:n], out=sums[1:])
            first, end = starts[a:b] - base, ends[a:b] - base
            out[a:b] = (sums[end] - sums[first]) * self.down[first]
            a = b
        return mixed(out + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words, by the first; the last n - 1 lack followers."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)
