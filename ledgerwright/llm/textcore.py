"""Vectorised text kernels shared by the corpus operators.

A *block* is a run of documents of a bounded number of bytes held as one
contiguous UTF-8 buffer with document offsets, so that every kernel is a few
NumPy passes over bytes and no Python loop touches a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; temporary arrays stay below about 12 times this.
BLOCK_BYTES = 1 << 21

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=_U)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)

#: ASCII blank characters: space and the controls 0x09 to 0x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(base: int) -> "callable":
    held = np.ones(1, dtype=_U)

    def upto(n: int) -> np.ndarray:
        nonlocal held
        while len(held) < n:
            step = _U(pow(base, len(held), 2**64))
            held = np.concatenate([held, held * step])
        return held[:n]

    return upto


_inverse_powers = _powers(_PINV)
_direct_powers = _powers(_P)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all of its input."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Block:
    """Documents ``lo`` to ``hi`` of a batch: bytes of document i are ``data[at[i]:at[i+1]]``."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the documents' offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about ``most`` bytes; a longer document is a block of its own."""
    data, at = text_buffer(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span in constant time."""
    out = np.empty(len(data) + 1, dtype=_U)
    out[0] = 0
    np.cumsum(_BYTE[data] * _inverse_powers(len(data)), dtype=_U, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes in [start, end); equal bytes give equal hashes anywhere."""
    h = (sums[end] - sums[start]) * _direct_powers(len(sums))[start]
    return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Maximal runs of non-blank bytes: byte spans, document (index in the block), 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document, and the total at the end


def words(block: Block, lower: bool = True, keep: np.ndarray | None = None) -> Words:
    """Split a block into words. ``keep`` marks the bytes that belong to words; by default all but ASCII blanks."""
    data, at = block.data, block.at
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~BLANK[data] if keep is None else keep[data]
    begin = np.zeros(n + 1, dtype=bool)
    begin[at[:-1][at[:-1] < n]] = True
    here = inside[1:-1]
    start = np.flatnonzero(here & (~inside[:-2] | begin[:n]))
    end = np.flatnonzero(here & (~inside[2:] | begin[1 : n + 1])) + 1
    # a word that touches the end of its document ends there even if the next one begins with a word
    sums = prefix_sums(LOWER[data] if lower else data)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(start, end, doc, span_hash(sums, start, end), first)


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside documents, and the index of each run's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    h = np.zeros(len(at), dtype=_U)
    for i in range(k):
        h = (h + w.hash[at + i]) * _U(_P)
        h ^= h >> _U(29)
    return mix(h), at


def shingle_sets(w: Words, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted, one document after another, and where each begins.

    A document of 1 to k-1 words has its whole word sequence as its only shingle;
    one without words has none.
    """
    h, at = ngrams(w, k)
    doc = w.doc[at] if len(at) else np.empty(0, np.int64)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        alone = np.zeros(len(short), dtype=_U)
        for i in range(k - 1):
            has = count[short] > i
            alone[has] = (alone[has] + w.hash[w.first[short[has]] + i]) * _U(_P)
            alone ^= alone >> _U(29)
        h = np.concatenate([h, mix(alone + count[short].astype(_U) * _U(0xA24BAED4963EE407))])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), dtype=bool)
    if len(h) > 1:
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    total = np.concatenate([[0], np.cumsum(fresh)])
    return h[fresh], total[cut]
