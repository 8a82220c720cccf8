"""Longest common subsequence of two lists of lines.

Common lines at both ends are a part of some longest subsequence, and lines that only one side has of none, so
both are set aside first.  What is left is solved exactly in one of two ways:

* With few pairs of equal lines (unique lines have one) the longest increasing run through these pairs is
  found by bisection, in time proportional to the pairs and the logarithm of the lines.
* Where lines repeat a lot, rows of the usual table are kept as the bits of one integer, 64 and more cells to
  an operation.  A table too large to keep is cut in half at the line through which a longest
  subsequence passes, and both halves are solved on their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of equal lines for each line up to which bisection is used.
PAIRS_EACH = 8
#: Bits of a table that is kept as a whole: 32 MB.
TABLE_BITS = 1 << 28

Match = tuple[int, int]


def matches(a: Sequence, b: Sequence) -> list[Match]:
    """Places (in a, in b) of a longest common subsequence, in order."""
    head, shorter = 0, min(len(a), len(b))
    while head < shorter and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < shorter - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    left, right = Counter(a[head : len(a) - tail]), Counter(b[head : len(b) - tail])
    mine = [i for i in range(head, len(a) - tail) if a[i] in right]
    other = [j for j in range(head, len(b) - tail) if b[j] in left]
    x, y = [a[i] for i in mine], [b[j] for j in other]
    pairs = sum(n * right[line] for line, n in left.items())
    solve = by_bisection if pairs <= PAIRS_EACH * (len(x) + len(y)) else by_bits
    middle = [(mine[i], other[j]) for i, j in solve(x, y)]
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [(i, i) for i in range(head)] + middle + ends


def by_bisection(a: Sequence, b: Sequence) -> list[Match]:
    places: dict = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    # the least place in b that a common subsequence of each length ends with, and how it got there
    least: list[int] = []
    ends: list[tuple] = []
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            k = bisect_left(least, j)
            step = i, j, ends[k - 1] if k else None
            if k == len(least):
                least.append(j)
                ends.append(step)
            elif j < least[k]:
                least[k], ends[k] = j, step
    out, step = [], ends[-1] if ends else None
    while step:
        out.append(step[:2])
        step = step[2]
    return out[::-1]


def _masks(b: Sequence) -> dict:
    masks: dict = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    return masks


def _rows(a: Sequence, b: Sequence, keep: bool) -> list[int]:
    """A row for each line of a (only the last one if not kept): bit j is 0 where b[j] makes it longer."""
    masks, full = _masks(b), (1 << len(b)) - 1
    row, rows = full, []
    for line in a:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(row: int, n: int) -> list[int]:
    """How long a common subsequence with the first 0, 1, .. n lines gets."""
    out = [0]
    for bit in reversed(f"{row:0{n}b}"):
        out.append(out[-1] + (bit == "0"))
    return out[: n + 1]


def by_bits(a: Sequence, b: Sequence) -> list[Match]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        before = _lengths(_rows(a[:half], b, False)[0], len(b))
        after = _lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[len(b) - j])
        rest = by_bits(a[half:], b[cut:])
        return by_bits(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in rest]
    rows = _rows(a, b, True)
    out: list[Match] = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def paired(a: Sequence, b: Sequence) -> list[tuple]:
    """The lines side by side: what stands alone has None beside it, removed lines before added ones."""
    out: list[tuple] = []
    i = j = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        out += [(line, None) for line in a[i:x]] + [(None, line) for line in b[j:y]]
        if x < len(a):
            out.append((a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def matches_of_codes(a: np.ndarray, b: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``matches`` of lines that are numbered; ``seen`` has a false for each number and is given back so.

    Where nothing but lines of one side alone tells the two apart, what is left is the same on both.
    """
    shorter = min(len(a), len(b))
    differ = np.flatnonzero(a[:shorter] != b[:shorter])
    head = int(differ[0]) if len(differ) else shorter
    x, y = a[head:], b[head:]
    mine, other = _also_in(x, y, seen), _also_in(y, x, seen)
    if len(mine) == len(other) and np.array_equal(x[mine], y[other]):
        before = np.arange(head)
        return np.concatenate([before, mine + head]), np.concatenate([before, other + head])
    found = np.array(matches(a.tolist(), b.tolist()), dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _also_in(x: np.ndarray, y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    seen[y] = True
    places = np.flatnonzero(seen[x])
    seen[y] = False
    return places


def _not_at(places: np.ndarray, n: int) -> np.ndarray:
    alone = np.ones(n, dtype=bool)
    alone[places] = False
    return np.flatnonzero(alone)


def places_side_by_side(a: np.ndarray, b: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``paired`` as places in a and in b, -1 for none."""
    i, j = matches_of_codes(a, b, seen)
    n, k = len(i), np.arange(len(i))
    left = np.full(len(a) + len(b) - n, -1, dtype=np.int64)
    right = left.copy()
    left[i + j - k], right[i + j - k] = i, j
    # a line that stands alone comes after the matches before it; removed lines before added ones
    only = _not_at(i, len(a))
    gap = np.searchsorted(i, only)
    left[only + np.concatenate([[0], j + 1 - (k + 1)])[gap]] = only
    only = _not_at(j, len(b))
    gap = np.searchsorted(j, only)
    right[only + np.concatenate([i - k, [len(a) - n]])[gap]] = only
    return left, right


def paired_lists(left: pa.Array, right: pa.Array) -> pa.Array:
    """``paired`` of each two lists as structs of l and r; null where either list is.

    Lines are numbered for the batch, and the strings of the result are taken from the given arrays.
    """
    present = np.asarray(pc.and_(left.is_valid(), right.is_valid()))
    sizes = [np.asarray(pc.fill_null(pc.list_value_length(side), 0), dtype=np.int64) for side in (left, right)]
    ends = [np.cumsum(size) for size in sizes]
    lines = [side.flatten() for side in (left, right)]
    both = pa.chunked_array([line.cast(pa.large_string()) for line in lines]).combine_chunks()
    numbered = both.dictionary_encode()
    codes = np.asarray(pc.fill_null(numbered.indices, -1), dtype=np.int64) + 1
    a, b = codes[: len(lines[0])], codes[len(lines[0]) :]
    seen = np.zeros(len(numbered.dictionary) + 1, dtype=bool)
    found, offsets = [], np.zeros(len(left) + 1, dtype=np.int32)
    for row, given in enumerate(present):
        offsets[row + 1] = offsets[row]
        if given:
            starts = [end[row] - size[row] for end, size in zip(ends, sizes)]
            x, y = (side[start : end[row]] for side, start, end in zip((a, b), starts, ends))
            places = places_side_by_side(x, y, seen)
            found.append([np.where(p < 0, -1, p + start) for p, start in zip(places, starts)])
            offsets[row + 1] += len(places[0])
    columns = []
    for side, name in enumerate(("l", "r")):
        place = np.concatenate([pair[side] for pair in found]) if found else np.zeros(0, dtype=np.int64)
        columns.append(lines[side].take(pa.array(place, mask=place < 0)).cast(pa.string()))
    kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    pairs = pa.StructArray.from_arrays(columns, names=["l", "r"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs, mask=pa.array(~present)).cast(kind)
