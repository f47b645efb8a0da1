"""Enhanced suffix array and its tree of common-prefix intervals, over a bounded shard of strings."""

from __future__ import annotations

import numpy as np

DIVERSE = -1


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the suffixes ``data[start[i]:end[i]]`` and give the common prefix of each with the one before it.

    Suffixes are laid side by side at the width of the longest, so memory is
    suffixes times that width: the caller shards to bound it.
    """
    n = len(start)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = end - start
    width = max(1, int(size.max()))
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    if int(size.min()) < width:
        table[np.arange(width) >= size[:, None]] = 0
    order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
    if (data == 0).any():  # padding and zero bytes compare alike: shorter first
        order = np.lexsort((size, _ranks(table, order)))
    table, size = table[order], size[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = table[1:] != table[:-1]
        at = differ.argmax(axis=1)
        at[~differ[np.arange(n - 1), at]] = width
        lcp[1:] = np.minimum(at, np.minimum(size[1:], size[:-1]))
    return order, lcp


def _ranks(table: np.ndarray, order: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(order), bool)
    fresh[1:] = (table[order][1:] != table[order][:-1]).any(axis=1)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _scan(lcp: list[int], left: list[int], least: int, base: int, out: list[tuple[int, int, int]]) -> None:
    """One pass with a stack over a run of suffixes; left-diverse intervals go to out."""
    stack: list[list[int]] = []
    n = len(left)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        lo, seen = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            d, lo, other = stack.pop()
            if other != seen:
                seen = DIVERSE
            if seen == DIVERSE:
                out.append((d, base + lo, base + i))
        if stack and stack[-1][0] == depth:
            if stack[-1][2] != seen:
                stack[-1][2] = DIVERSE
        elif depth >= least:
            stack.append([depth, lo, seen])


def repeat_intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the suffix array whose suffixes share a prefix of at least ``least`` bytes that can be
    extended neither right (the interval's own depth) nor left (two of them have different bytes before them).

    ``left`` holds the byte before each suffix, or DIVERSE where there is none. Returns depth, first and
    end of each interval. Runs whose suffixes all have the same byte before them hold no such interval
    and are left out before the scan; a run of two is an interval itself.
    """
    n = len(lcp)
    joined = np.zeros(n + 1, bool)
    joined[1:n] = lcp[1:] >= least
    lo = np.flatnonzero(joined[1:] & ~joined[:-1])
    hi = np.flatnonzero(~joined[1:] & joined[:-1]) + 1
    if not len(lo):
        return (np.empty(0, np.int64),) * 3
    cuts = np.column_stack([lo, hi]).ravel()
    wide = np.append(left, 0)
    least_left = np.minimum.reduceat(wide, cuts)[::2]
    most_left = np.maximum.reduceat(wide, cuts)[::2]
    diverse = (least_left == DIVERSE) | (least_left != most_left)
    pair = diverse & (hi - lo == 2)
    out: list[tuple[int, int, int]] = []
    for a, b in zip(lo[diverse & ~pair].tolist(), hi[diverse & ~pair].tolist()):
        _scan(lcp[a:b].tolist(), left[a:b].tolist(), least, a, out)
    rest = np.array(out, np.int64).reshape(-1, 3)
    a = lo[pair]
    return np.concatenate([lcp[a + 1], rest[:, 0]]), np.concatenate([a, rest[:, 1]]), np.concatenate([a + 2, rest[:, 2]])


def maximal_repeats(strings: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of at least ``least`` bytes in strings, each as its length and every (string, offset).

    A repeat never crosses strings. Empty strings and no strings give no repeats.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    counts = np.maximum(np.diff(at) - least + 1, 0)
    owner = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = at[owner] + offset
    order, lcp = suffix_array(data, start, at[owner + 1] if len(owner) else start)
    owner, offset, start = owner[order], offset[order], start[order]
    left = np.where(offset > 0, data[np.maximum(start - 1, 0)].astype(np.int64) if len(data) else 0, DIVERSE)
    return [(int(d), sorted(zip(owner[a:b].tolist(), offset[a:b].tolist()))) for d, a, b in zip(*repeat_intervals(lcp, left, least))]
