"""Removal of long repeated passages by suffix arrays over shards of the corpus.

Every string of ``least`` bytes has one *anchor*, the smallest hash among its
``seed``-byte substrings. Equal strings have equal anchors, so a shard that
gathers all stretches with one anchor sees all occurrences of each of its
strings, and suffix arrays of shards together find what one suffix array of the
whole corpus would. Four steps, each over bounded groups:

1. each block of documents sends the distinct anchors it holds;
2. anchors found in two documents are sent back to the blocks that hold them;
3. a block sends each distinct stretch around such an anchor once, with the two
   smallest documents that hold it, however often the block repeats it;
4. a shard sorts the suffixes of its distinct stretches, scans the intervals of
   common prefixes with a stack, keeps the left-diverse ones (maximal repeats
   with all their occurrences), and answers the blocks with spans to remove.

A passage in a third of all documents thus costs one row a block, not one a document. A phrase shorter than
``least`` in many otherwise different documents can be the anchor of very many stretches: those of such an anchor
are cut into their strings and dealt to as many shards as their number asks for, by the strings' own hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .session import durable, release, ship
from .suffix import DIVERSE, repeat_intervals, suffix_array

SEED = 20
#: Text of a block and of a shard in bytes: a share of the corpus within these bounds.
BLOCK_TEXT = (1 << 20, 64 << 20)
SHARD_TEXT = (2 << 20, 128 << 20)
#: Bytes of stretches whose suffixes are sorted at once.
SHARD_BYTES = 6 << 20
#: Distinct stretches of one anchor that one shard takes, some 80 bytes each.
ANCHOR_STRETCHES = 1 << 14
#: Bits of an anchor. Two that come to be alike share a shard for nothing, and repeats are found on the texts all the same.
ANCHOR_BITS = 42
#: Texts go to their block in compressed pieces of a share of the block, in bytes.
PIECE_TEXT = (64 << 10, 1 << 20)
_NONE = np.iinfo(np.int64).max


def _window_min(a: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    rest = w - n
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def stretches(block: tc.Block, least: int, seed: int):
    """Runs of consecutive strings of ``least`` bytes with one anchor: anchor, first byte, end, document, prefix sums.

    A run has at most least-seed+1 strings, so a stretch has less than twice ``least`` bytes.
    """
    data, at = block.data, block.at
    n = len(data) - least + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e, e, np.zeros(1, np.uint64)
    sums = tc.prefix_sums(data)
    m = len(data) - seed + 1
    h = tc.mix((sums[seed:] - sums[:-seed]) * tc._direct_powers(m))
    anchor = _window_min(h, least - seed + 1)
    doc = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(at))
    whole = doc[:n] == doc[least - 1 :]
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(fresh & whole)
    stop = np.flatnonzero(np.append(fresh[1:] | ~whole[1:], True) & whole) + 1
    most = least - seed + 1
    pieces = -(-(stop - first) // most)
    if len(pieces) and pieces.max() > 1:
        own = np.repeat(np.arange(len(first)), pieces)
        k = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop = np.minimum(first[own] + (k + 1) * most, stop[own])
        first = first[own] + k * most
    return tc.mix(anchor[first]) >> np.uint64(64 - ANCHOR_BITS), first, stop + least - 1, doc[first], sums


def _pieces(most: int, blocks: int):
    """Rows of doc_id and text in compressed pieces of about ``most`` bytes of text, dealt to blocks in turn. A text that is
    repeated very often so goes to different blocks."""

    def run(batches):
        part = np.array([TaskContext.get().partitionId()], np.uint64)
        number, held, size = int(tc.mix(part + np.uint64(1))[0]) % blocks, [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number % blocks], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

        for batch in batches:
            for b in tc.blocks(batch.column(1), most):
                weight = len(b.data) + 16 * len(b)
                if held and size + weight > most:
                    yield flush()
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(b.lo, len(b)))
                size += weight
        if held:
            yield flush()
        release()

    return run


def _documents(table: pa.Table) -> pa.Table:
    if "rows" in table.column_names:
        table = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows")])
    return table.select(["doc_id", "text"]).combine_chunks()


def _runs(x: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return np.flatnonzero(fresh)


def _runs_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return np.flatnonzero(fresh)


def _packed(x: np.ndarray) -> bytes:
    """Compressed by places of bytes: the high ones of numbers that are near each other are alike."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpacked(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _ascending(x: np.ndarray) -> bytes:
    return _packed(np.diff(x, prepend=np.uint64(0)))


def _ascended(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64)


def _anchors(table: pa.Table, least: int, seed: int, shards: int) -> pa.Table:
    """Step 1. Per shard: the block's anchors, and of each whether several documents have it and, as a logarithm
    rounded up, how many different stretches it has."""
    block_id = table.column("block")[0].as_py()
    table = _documents(table)
    ids = table.column("doc_id").to_numpy()
    found, docs, keys = [], [], []
    for b in tc.blocks(table.column("text")):
        a, lo, hi, d, sums = stretches(b, least, seed)
        keep = ids[b.lo + d] != _NONE
        found.append(a[keep])
        docs.append(ids[b.lo + d][keep])
        keys.append(tc.span_hash(sums, lo[keep], hi[keep]))
    a, d, k = np.concatenate(found), np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(a, kind="stable")
    a, d, k = a[order], d[order], k[order]
    first = _runs(a)
    several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(first) else np.empty(0, bool)
    # different stretches of anchors that are there more than once
    number = np.diff(np.append(first, len(a)))
    more = number > 1
    own, again = np.repeat(np.arange(len(first)), number), np.repeat(more, number)
    own, k = own[again], k[again]
    order = np.lexsort((k, own))
    number[more] = np.bincount(own[order][_runs(k[order])], minlength=len(first))[more]
    mark = (several + 2 * np.ceil(np.log2(number))).astype(np.uint8)
    a = a[first]
    shard = ((a * np.uint64(shards)) >> np.uint64(ANCHOR_BITS)).astype(np.int64)  # ranges of anchors, which are in order
    rows = {"shard": [], "block": [], "anchors": [], "marks": []}
    cut = _runs(shard).tolist() + [len(a)]
    for lo, hi in zip(cut[:-1], cut[1:]):
        rows["shard"].append(int(shard[lo]))
        rows["block"].append(block_id)
        rows["anchors"].append(_ascending(a[lo:hi]))
        rows["marks"].append(_packed(mark[lo:hi]))
    return pa.table(rows, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary()), ("marks", pa.binary())]))


def _shared(table: pa.Table, most: int) -> pa.Table:
    """Step 2. To each block, those of its anchors that a second document has, and among how many shards (a power
    of two, as its logarithm) each one's stretches are dealt."""
    blocks = table.column("block").to_numpy()
    anchors = [_ascended(x) for x in table.column("anchors").to_pylist()]
    a = np.concatenate(anchors)
    mark = np.concatenate([_unpacked(x, np.uint8) for x in table.column("marks").to_pylist()])
    where = np.repeat(np.arange(len(blocks)), [len(x) for x in anchors])
    order = np.argsort(a, kind="stable")
    a, where, mark = a[order], where[order], mark[order]
    first = _runs(a)
    counts = np.diff(np.append(first, len(a)))
    some = len(first) > 0
    good = (counts > 1) | (np.maximum.reduceat(mark & 1, first) > 0 if some else np.empty(0, bool))
    number = np.add.reduceat(np.left_shift(1, (mark >> 1).astype(np.int64)), first) if some else first
    pieces = np.ceil(np.log2(np.maximum(number / most, 1))).astype(np.uint8)
    keep = np.repeat(good, counts)
    a, where, pieces = a[keep], where[keep], np.repeat(pieces, counts)[keep]
    order = np.argsort(where, kind="stable")
    a, where, pieces = a[order], where[order], pieces[order]
    cut = _runs(where).tolist() + [len(a)]
    return pa.table(
        {"block": [int(blocks[where[lo]]) for lo in cut[:-1]], "anchors": [_ascending(a[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])], "pieces": [_packed(pieces[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])]},
        schema=pa.schema([("block", pa.int64()), ("anchors", pa.binary()), ("pieces", pa.binary())]),
    )


def _dealt(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray, pieces: np.ndarray, sums: np.ndarray, least: int):
    """Stretches with their hashes; those whose anchor is dealt to several shards as their strings, each under an
    anchor of its own that tells the shard. Last: which ones are such strings."""
    wide = pieces > 0
    k = tc.span_hash(sums, lo[~wide], hi[~wide])
    if not wide.any():
        return a, lo, hi, d, k, np.zeros(len(a), bool)
    n = hi[wide] - lo[wide] - least + 1
    own = np.repeat(np.flatnonzero(wide), n)
    start = np.repeat(lo[wide] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    single = tc.span_hash(sums, start, start + least)
    under = tc.mix(a[own] + (single >> (np.uint64(64) - pieces[own].astype(np.uint64))) + np.uint64(1))
    join = lambda x, y: np.concatenate([x[~wide], y])
    return join(a, under), join(lo, start), join(hi, start + least), join(d, d[own]), np.concatenate([k, single]), np.arange(len(k) + len(own)) >= len(k)


_STRETCH = [("shard", pa.int64()), ("block", pa.int64()), ("anchor", pa.binary()), ("doc", pa.binary()), ("next", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())]


def _two_least(group_first: np.ndarray, doc: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two smallest different documents of each group, or _NONE where there is no second."""
    low = np.minimum.reduceat(doc, group_first)
    counts = np.diff(np.append(group_first, len(doc)))
    spread = np.repeat(low, counts)
    second = np.minimum(np.where(doc > spread, doc, _NONE), np.where(nxt > spread, nxt, _NONE))
    return low, np.minimum.reduceat(second, group_first)


def _stretches(key, docs: pa.Table, answers: pa.Table, least: int, seed: int, shards: int) -> pa.Table:
    """Step 3. Per shard: the distinct stretches of the block with a shared anchor."""
    schema = pa.schema(_STRETCH)
    if not docs.num_rows or not answers.num_rows:
        return schema.empty_table()
    docs = _documents(docs)
    ids = docs.column("doc_id").to_numpy()
    shared = np.concatenate([_ascended(x) for x in answers.column("anchors").to_pylist()])
    pieces = np.concatenate([_unpacked(x, np.uint8) for x in answers.column("pieces").to_pylist()])
    if not len(shared):
        return schema.empty_table()
    order = np.argsort(shared)
    shared, pieces = shared[order], pieces[order]
    a_, k_, d_, s_, t_, o_ = [], [], [], [], [], []
    for b in tc.blocks(docs.column("text")):
        a, lo, hi, d, sums = stretches(b, least, seed)
        if not len(a):
            continue
        at = np.minimum(np.searchsorted(shared, a), len(shared) - 1)
        keep = (shared[at] == a) & (ids[b.lo + d] != _NONE)
        a, lo, hi, d, k, one = _dealt(a[keep], lo[keep], hi[keep], ids[b.lo + d[keep]], pieces[at[keep]], sums, least)
        order = np.lexsort((d, k))  # here already each distinct stretch once; equal ones have one anchor
        k, a, lo, hi, d, one = k[order], a[order], lo[order], hi[order], d[order], one[order]
        first = _runs(k)
        if not len(first):
            continue
        low, second = _two_least(first, d, np.full(len(d), _NONE))
        size = (hi - lo)[first]
        a_.append(a[first]), k_.append(k[first]), d_.append(np.column_stack([low, second])), s_.append(size), o_.append(one[first])
        pos = np.repeat(lo[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        t_.append(b.data[pos])
    if not a_:
        return schema.empty_table()
    a, k, d, size, text, one = (np.concatenate(x) for x in (a_, k_, d_, s_, t_, o_))
    begin = np.cumsum(size) - size
    order = np.lexsort((k, a % np.uint64(shards)))
    a, k, d, size, begin, one = a[order], k[order], d[order], size[order], begin[order], one[order]
    first = _runs(k)
    low, second = _two_least(first, d[:, 0], d[:, 1])
    a, size, begin, one = a[first], size[first], begin[first], one[first]
    shard = (a % np.uint64(shards)).astype(np.int64)
    cut = _runs(shard).tolist() + [len(a)]
    rows = []
    for x, y in zip(cut[:-1], cut[1:]):
        z = size[x:y]
        pos = np.repeat(begin[x:y] - (np.cumsum(z) - z), z) + np.arange(z.sum())
        rows.append((int(shard[x]), key[0].as_py(), a[x:y].tobytes(), _packed(low[x:y]), _packed(second[x:y]), _packed((z + (one[x:y].astype(np.int64) << 15)).astype(np.uint16)), _packed(text[pos])))
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _STRETCH)], schema=schema)


#: single: whether the keys are those of strings, or of stretches.
_SPANS = [("block", pa.int64()), ("single", pa.bool_()), ("key", pa.binary()), ("at", pa.binary()), ("size", pa.binary()), ("doc", pa.binary())]


def _keys(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches' hashes, as their blocks know them, some MB of text at a time."""
    out = np.empty(len(size), np.uint64)
    edges = np.append(np.searchsorted(begin, np.arange(0, len(text), tc.BLOCK_BYTES)), len(size))
    for x, y in zip(edges[:-1], edges[1:]):
        if x < y:
            base = begin[x]
            out[x:y] = tc.span_hash(tc.prefix_sums(text[base : begin[y - 1] + size[y - 1]]), begin[x:y] - base, begin[x:y] - base + size[x:y])
    return out


def _repeats(table: pa.Table, least: int) -> pa.Table:
    """Step 4. Maximal repeats of the shard's stretches, as spans for every block that holds the stretch."""
    schema = pa.schema(_SPANS)
    col = lambda name, kind: np.concatenate([_unpacked(x, kind) for x in table.column(name).to_pylist()])
    anchors = [np.frombuffer(x, np.uint64) for x in table.column("anchor").to_pylist()]
    block = np.repeat(table.column("block").to_numpy(), [len(x) for x in anchors])
    a = np.concatenate(anchors)
    doc, nxt, size, text = col("doc", np.int64), col("next", np.int64), col("size", np.uint16).astype(np.int64), col("bytes", np.uint8)
    one, size = size >> 15, size & 0x7FFF
    begin = np.cumsum(size) - size
    k = _keys(text, begin, size)
    order = np.lexsort((k, a))
    a, k, doc, nxt, size, begin, block, one = a[order], k[order], doc[order], nxt[order], size[order], begin[order], block[order], one[order]
    first = _runs_of(a, k)
    counts = np.diff(np.append(first, len(k)))
    low, second = _two_least(first, doc, nxt)
    ua, us, ub = a[first], size[first], begin[first]
    group = _runs(ua)  # an anchor's stretches stay in one suffix array
    weight = np.add.reduceat(us, group)
    part = np.cumsum(weight) // SHARD_BYTES
    edges = group[_runs(part)].tolist() + [len(ua)]
    found = [_spans_of(text, ub[x:y], us[x:y], low[x:y], second[x:y], least, x) for x, y in zip(edges[:-1], edges[1:])]
    own, at, span, least_doc = (np.concatenate(c) for c in zip(*found))
    if not len(own):
        return schema.empty_table()
    n_to = counts[own]  # each block that holds the stretch gets the span
    pick = np.repeat(np.arange(len(own)), n_to)
    entry = np.repeat(first[own] - (np.cumsum(n_to) - n_to), n_to) + np.arange(n_to.sum())
    least_doc = least_doc[pick]
    use = (doc[entry] > least_doc) | (nxt[entry] != _NONE)
    pick, entry, least_doc = pick[use], entry[use], least_doc[use]
    order = np.lexsort((k[entry], one[entry], block[entry]))
    pick, entry, least_doc = pick[order], entry[order], least_doc[order]
    to, single = block[entry], one[entry]
    cut = _runs_of(to, single).tolist() + [len(to)]
    rows = [(int(to[x]), bool(single[x]), _ascending(k[entry[x:y]]), _packed(at[pick[x:y]].astype(np.uint16)), _packed(span[pick[x:y]].astype(np.uint16)), _packed(least_doc[x:y])) for x, y in zip(cut[:-1], cut[1:])]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _SPANS)], schema=schema) if rows else schema.empty_table()


def _spans_of(text, begin, size, low, second, least, base):
    """Left-diverse intervals of one suffix array: stretch, offset, length and smallest document of each occurrence."""
    n = size - least + 1
    own = np.repeat(np.arange(len(size)), n)
    off = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[own] + off
    order, lcp = suffix_array(text, start, (begin + size)[own])
    own, off, start = own[order], off[order], start[order]
    left = np.where(off > 0, text[np.maximum(start - 1, 0)].astype(np.int64), DIVERSE)
    twice = 1 + (second[own] != _NONE)  # a stretch of several documents is a repeat of itself
    entry = np.repeat(np.arange(len(own)), twice)
    lcp = np.where(np.append(False, entry[1:] == entry[:-1]), (size[own] - off)[entry], lcp[entry])
    depth, lo, hi = repeat_intervals(lcp, left[entry], least)
    if not len(depth):
        e = np.empty(0, np.int64)
        return e, e, e, e
    docs = low[own[entry]]
    cuts = np.column_stack([lo, hi]).ravel()
    low_doc = np.minimum.reduceat(np.append(docs, _NONE), cuts)[::2]
    width = hi - lo
    which = np.repeat(np.arange(len(lo)), width)
    member = entry[np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())]
    fresh = np.append(True, (member[1:] != member[:-1]) | (which[1:] != which[:-1]))
    which, member = which[fresh], member[fresh]
    o = own[member]
    use = (low[o] > low_doc[which]) | (second[o] != _NONE)
    return base + o[use], off[member][use], depth[which][use], low_doc[which][use]


_RESULT = "doc_id bigint, text string, kept binary, spans array<struct<start:bigint,end:bigint>>"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _strings(block: tc.Block, least: int, seed: int):
    """As stretches gives them, every string of ``least`` bytes by itself; without anchors."""
    n = max(0, len(block.data) - least + 1)
    doc = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(block.at))
    first = np.flatnonzero(doc[:n] == doc[least - 1 :]) if n else np.empty(0, np.int64)
    return None, first, first + least, doc[first], tc.prefix_sums(block.data)


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, and of each a span in its stretch and the smallest document that has the span."""
    col = lambda name, kind: np.concatenate([np.empty(0, kind)] + [_unpacked(x, kind) for x in answers.column(name).to_pylist()])
    key = np.concatenate([np.empty(0, np.uint64)] + [_ascended(x) for x in answers.column("key").to_pylist()])
    at, size, low = col("at", np.uint16).astype(np.int64), col("size", np.uint16).astype(np.int64), col("doc", np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], at[order], size[order], low[order]


def _removed(docs: pa.Table, answers: pa.Table, least: int, seed: int) -> pa.Table:
    """Last step: the union of spans of each document, and the bytes outside it."""
    docs = _documents(docs)
    ids = docs.column("doc_id").to_numpy()
    told = [_told(answers.filter(pc.equal(answers.column("single"), single))) for single in (False, True)]
    kept_parts, kept_len, span_doc, span_lo, span_hi = [], [], [], [], []
    for b in tc.blocks(docs.column("text")):
        n = len(b.data)
        gone = np.zeros(n + 1, np.int64)
        for (key, at, size, low), cut in zip(told, (stretches, _strings)):
            if not len(key):
                continue
            _, lo, hi, d, sums = cut(b, least, seed)
            if not len(lo):
                continue
            k = tc.span_hash(sums, lo, hi)
            x = np.searchsorted(key, k, side="left")
            hits = np.flatnonzero((x < len(key)) & (key[np.minimum(x, len(key) - 1)] == k) & (ids[b.lo + d] != _NONE))
            x = x[hits]
            count = np.searchsorted(key, k[hits], side="right") - x
            own = np.repeat(hits, count)
            ans = np.repeat(x - (np.cumsum(count) - count), count) + np.arange(count.sum())
            use = low[ans] < ids[b.lo + d[own]]
            own, ans = own[use], ans[use]
            gone += np.bincount(lo[own] + at[ans], minlength=n + 1)
            gone -= np.bincount(lo[own] + at[ans] + size[ans], minlength=n + 1)
        out = np.cumsum(gone)[:n] > 0
        kept_parts.append(b.data[~out])
        total = np.concatenate([[0], np.cumsum(~out)])
        kept_len.append(np.diff(total[b.at]))
        edge = np.zeros(n, bool)
        edge[b.at[:-1][b.at[:-1] < n]] = True
        before = np.concatenate([[False], out[:-1]]) if n else out
        after = np.concatenate([out[1:], [False]]) if n else out
        last = np.concatenate([edge[1:], [True]]) if n else edge
        s = np.flatnonzero(out & (~before | edge))
        e = np.flatnonzero(out & (~after | last)) + 1
        i = np.searchsorted(b.at, s, side="right") - 1
        span_doc.append(b.lo + i), span_lo.append(s - b.at[i]), span_hi.append(e - b.at[i])
    kept = np.concatenate(kept_parts)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(kept_len))]).astype(np.int32)
    doc = np.concatenate(span_doc)
    per = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs.num_rows))]).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array(np.concatenate(span_lo)), pa.array(np.concatenate(span_hi))], ["start", "end"]))
    kept = pa.Array.from_buffers(pa.binary(), docs.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())])
    text = docs.column("text")
    ids = pa.array(ids, mask=ids == _NONE)
    return pa.table([ids, text, kept, spans.cast(_RESULT_ARROW.field("spans").type)], schema=_RESULT_ARROW)


def remove_repeats(docs: DataFrame, least: int = 50, seed: int = SEED, anchor_stretches: int = ANCHOR_STRETCHES) -> DataFrame:
    """Remove every byte covered by a ``least``-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, text, kept (binary: the remaining bytes joined) and spans (maximal removed runs
    in byte offsets), one row for each row of docs. Texts are taken as UTF-8; a null or empty text
    keeps nothing and has no spans; strings never cross documents; texts shorter than ``least`` stay whole.
    A row with a null doc_id is neither a source nor changed. Rows with the same doc_id are no sources for
    each other. Other columns are not read. An empty table gives an empty result.
    """
    if not 1 <= seed <= least < 1 << 14:
        raise ValueError("seed has to be between 1 and least, and least below 16384")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n_blocks, shards = (max(1, -(-size // min(most, max(fewest, size // n)))) for (fewest, most), n in ((BLOCK_TEXT, 256), (SHARD_TEXT, 128)))
    fewest, most = PIECE_TEXT
    piece = max(fewest, min(most, size // n_blocks // 16))
    # all three uses below share one shuffle of the texts
    docs = docs.select(F.coalesce("doc_id", F.lit(_NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pieces(piece, n_blocks), "block bigint, rows binary")
    anchors = docs.groupBy("block").applyInArrow(_grouped(_anchors, least=least, seed=seed, shards=shards), "shard bigint, block bigint, anchors binary, marks binary")
    shared = anchors.groupBy("shard").applyInArrow(_grouped(_shared, most=anchor_stretches), "block bigint, anchors binary, pieces binary")
    found = docs.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _cogrouped(_stretches, least=least, seed=seed, shards=shards), "shard bigint, block bigint, anchor binary, doc binary, next binary, size binary, bytes binary"
    )
    spans = found.groupBy("shard").applyInArrow(_grouped(_repeats, least=least), "block bigint, single boolean, key binary, at binary, size binary, doc binary")
    return docs.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cogrouped_plain(_removed, least=least, seed=seed), _RESULT)


# Repeat groups: maximal repeats of any length, with all occurrences.
#
# A maximal repeat begins with a string of ``least`` bytes that occurs twice and has different bytes before it, and all
# strings within it occur twice. So blocks send their strings' hashes with the bytes before them; shards of hashes answer
# which occur twice and which are left-diverse; blocks send the text from each left-diverse string to where strings
# that occur twice end, once for each different text; shards of first strings sort these, scan their common prefixes with a
# stack, and answer with the left-diverse intervals, whose occurrences the blocks list. What is sent is repeated text alone.

_SEEN = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("left", pa.binary()), ("twice", pa.binary())])
_TWICE = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("diverse", pa.binary())])
_CONTEXT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("key", pa.int64()), ("left", pa.int16()), ("twice", pa.bool_()), ("bytes", pa.binary())])
_MEMBER = pa.schema([("block", pa.int64()), ("key", pa.binary()), ("group", pa.binary()), ("length", pa.binary())])
_OCCURRENCE = pa.schema([("group", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64())])


def _before(block: tc.Block, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The byte before each place, DIVERSE at a document's begin."""
    return np.where(start > block.at[:-1][doc], block.data[np.maximum(start - 1, 0)].astype(np.int16), np.int16(DIVERSE))


def _by_key(key: np.ndarray, left: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once: the byte before it, or DIVERSE if there are several, and whether it is there twice."""
    order = np.argsort(key, kind="stable")
    key, left, twice = key[order], left[order], twice[order]
    first = _runs(key)
    if not len(first):
        return key, left, twice
    low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
    number = np.diff(np.append(first, len(key)))
    return key[first], np.where(low == high, low, np.int16(DIVERSE)).astype(np.int16), (number > 1) | np.logical_or.reduceat(twice, first)


def _seen(table: pa.Table, least: int, shards: int) -> pa.Table:
    block_id = table.column("block")[0].as_py()
    keys, lefts = [np.empty(0, np.uint64)], [np.empty(0, np.int16)]
    for b in tc.blocks(_documents(table).column("text")):
        _, first, end, doc, sums = _strings(b, least, 0)
        keys.append(tc.span_hash(sums, first, end))
        lefts.append(_before(b, first, doc))
    key, left, twice = _by_key(np.concatenate(keys), np.concatenate(lefts), np.zeros(sum(map(len, keys)), bool))
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    key, left, twice, shard = key[order], left[order], twice[order], shard[order]
    cut = _runs(shard).tolist() + [len(key)]
    rows = [(int(shard[x]), block_id, key[x:y].tobytes(), left[x:y].tobytes(), twice[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])]
    return pa.table([pa.array(c, t.type) for c, t in zip(list(zip(*rows)) or [[]] * 5, _SEEN)], schema=_SEEN)


def _occur_twice(table: pa.Table) -> pa.Table:
    col = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    keys, left, twice = col("keys", np.uint64), col("left", np.int16), col("twice", bool)
    key, one, more = _by_key(np.concatenate(keys), np.concatenate(left), np.concatenate(twice))
    rows = []
    for block, own in zip(table.column("block").to_pylist(), keys):
        at = np.searchsorted(key, own)
        own, at = own[more[at]], at[more[at]]
        if len(own):
            rows.append((block, own.tobytes(), (one[at] == DIVERSE).tobytes()))
    return pa.table([pa.array(c, t.type) for c, t in zip(list(zip(*rows)) or [[]] * 3, _TWICE)], schema=_TWICE)


def _contexts_of(b: tc.Block, keys: np.ndarray, diverse: np.ndarray, least: int, overlapping: bool):
    """Of each left-diverse string that occurs twice: its hash, place, document, the end of the run of such strings that it
    is in, and the block's prefix sums. Unless ``overlapping``, not those that overlap the same string before them."""
    _, first, end, doc, sums = _strings(b, least, 0)
    k = tc.span_hash(sums, first, end)
    at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
    hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
    follows = np.append((first[1:] == first[:-1] + 1) & hit[1:] & (doc[1:] == doc[:-1]), False) if len(first) else hit
    stops = np.flatnonzero(~follows)
    stop = first[stops[np.searchsorted(stops, np.arange(len(first)))]] + least if len(first) else first
    pick = np.flatnonzero(hit & diverse[at]) if len(keys) else np.empty(0, np.int64)
    if not overlapping and len(pick):
        order = np.lexsort((first[pick], k[pick], doc[pick]))
        p = pick[order]
        near = np.append(False, (k[p[1:]] == k[p[:-1]]) & (doc[p[1:]] == doc[p[:-1]]) & (first[p[1:]] - first[p[:-1]] < least))
        pick = np.sort(p[~near])
    return k[pick], first[pick], doc[pick], stop[pick], sums


def _answers(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    join = lambda name, kind: np.concatenate([np.empty(0, kind)] + [np.frombuffer(x, kind) for x in answers.column(name).to_pylist()])
    keys, diverse = join("keys", np.uint64), join("diverse", bool)
    order = np.argsort(keys)
    return keys[order], diverse[order]


def _contexts(key, docs: pa.Table, answers: pa.Table, least: int, shards: int, overlapping: bool) -> pa.Table:
    found: dict[int, list] = {}
    if docs.num_rows and answers.num_rows:
        keys, diverse = _answers(answers)
        for b in tc.blocks(_documents(docs).column("text")):
            k, lo, doc, hi, sums = _contexts_of(b, keys, diverse, least, overlapping)
            h, left = tc.span_hash(sums, lo, hi).view(np.int64), _before(b, lo, doc)
            for first, context, x, y, byte in zip(k.view(np.int64).tolist(), h.tolist(), lo.tolist(), hi.tolist(), left.tolist()):
                row = found.get(context)
                if row is None:
                    found[context] = [first % shards, key[0].as_py(), first, context, byte, False, b.data[x:y].tobytes()]
                else:
                    row[4], row[5] = (byte if row[4] == byte else DIVERSE), True
    return pa.table([pa.array(c, t.type) for c, t in zip(list(zip(*found.values())) or [[]] * 7, _CONTEXT)], schema=_CONTEXT)


def _groups(table: pa.Table, least: int) -> pa.Table:
    """Common-prefix intervals of the contexts that begin with one string: to each block, the groups of its contexts."""
    col = {c: table.column(c).to_numpy() for c in ("block", "first", "key", "left", "twice")}
    texts = table.column("bytes").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (col["first"][i], texts[i]))
    rows: dict[int, list[tuple[int, int, int]]] = {}
    cut = _runs(col["first"][order]).tolist() + [len(order)]
    for x, y in zip(cut[:-1], cut[1:]):
        # equal contexts of several blocks lie together; one that occurs twice is two entries
        entry = [i for i in order[x:y] for _ in range(1 + bool(col["twice"][i]))]
        lcp = np.zeros(len(entry), np.int64)
        for n in range(1, len(entry)):
            lcp[n] = _common(texts[entry[n - 1]], texts[entry[n]])
        for depth, lo, hi in zip(*repeat_intervals(lcp, col["left"][entry].astype(np.int64), least)):
            name = int.from_bytes(hashlib.blake2b(texts[entry[lo]][:depth], digest_size=8).digest(), "little", signed=True)
            for i in dict.fromkeys(entry[lo:hi]):
                rows.setdefault(int(col["block"][i]), []).append((int(col["key"][i]), name, int(depth)))
    out = [(block, *(np.array([m[k] for m in members], kind).tobytes() for k, kind in enumerate((np.int64, np.int64, np.int64)))) for block, members in rows.items()]
    return pa.table([pa.array(c, t.type) for c, t in zip(list(zip(*out)) or [[]] * 4, _MEMBER)], schema=_MEMBER)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def _occurrences(docs: pa.Table, answers: pa.Table, least: int, overlapping: bool) -> pa.Table:
    out = []
    asked = answers.filter(pc.is_valid(answers.column("keys")))
    told = answers.filter(pc.is_valid(answers.column("key")))
    if docs.num_rows and told.num_rows:
        docs = _documents(docs)
        ids = docs.column("doc_id").to_numpy()
        keys, diverse = _answers(asked)
        key, group, length = (np.concatenate([np.frombuffer(x, kind) for x in told.column(c).to_pylist()]) for c, kind in (("key", np.uint64), ("group", np.int64), ("length", np.int64)))
        order = np.argsort(key, kind="stable")
        key, group, length = key[order], group[order], length[order]
        for b in tc.blocks(docs.column("text")):
            _, lo, doc, hi, sums = _contexts_of(b, keys, diverse, least, overlapping)
            h = tc.span_hash(sums, lo, hi)
            x, y = np.searchsorted(key, h, side="left"), np.searchsorted(key, h, side="right")
            own = np.repeat(np.arange(len(h)), y - x)
            at = np.repeat(x - (np.cumsum(y - x) - (y - x)), y - x) + np.arange(len(own))
            d = ids[b.lo + doc[own]]
            out.append(pa.table([pa.array(group[at]), pa.array(length[at]), pa.array(d, mask=d == _NONE), pa.array(lo[own] - b.at[doc[own]])], schema=_OCCURRENCE))
    return pa.concat_tables(out) if out else _OCCURRENCE.empty_table()


def repeat_groups(docs: DataFrame, least: int = 50, overlapping: bool = False) -> DataFrame:
    """All maximal repeats of at least ``least`` bytes, each with all its occurrences: group (names equal texts alike), length,
    doc_id and offset (bytes), a row for each occurrence.

    A repeat is maximal if its occurrences have different bytes, or a text's begin or end, before and after them. An
    occurrence whose first ``least`` bytes overlap the same bytes just before them is left out unless ``overlapping``:
    a text of one letter repeats itself at every length and place, a number that grows with the square of its size.
    Texts are taken as UTF-8 and repeats never cross them; a text's repeats of itself count. Rows are texts of their own
    whatever their doc_id, and a null one is given back as null. Null, empty and shorter texts have no repeats. Other
    columns are not read. Without repeats the result is empty.
    """
    if least < 1:
        raise ValueError("least has to be at least 1")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n_blocks, shards = max(1, -(-size // (4 << 20))), max(1, -(-size // (2 << 20)))
    docs = docs.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks)).alias("block"), F.coalesce("doc_id", F.lit(_NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = docs.groupBy("block").applyInArrow(_grouped(_seen, least=least, shards=shards), "shard bigint, block bigint, keys binary, left binary, twice binary")
    twice = durable(seen.groupBy("shard").applyInArrow(_grouped(_occur_twice), "block bigint, keys binary, diverse binary"))
    contexts = docs.groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(_cogrouped(_contexts, least=least, shards=shards, overlapping=overlapping), "shard bigint, block bigint, first bigint, key bigint, left smallint, twice boolean, bytes binary")
    members = contexts.groupBy("shard").applyInArrow(_grouped(_groups, least=least), "block bigint, key binary, group binary, length binary")
    answers = twice.unionByName(members, allowMissingColumns=True)
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cogrouped_occurrences(least, overlapping), "group bigint, length bigint, doc_id bigint, offset bigint")


def _cogrouped_occurrences(least: int, overlapping: bool):
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return _occurrences(left, right, least, overlapping)
        finally:
            release()

    return apply


def _grouped(f, **parameters):
    def apply(table: pa.Table) -> pa.Table:
        try:
            return f(table, **parameters)
        finally:
            release()

    return apply


def _cogrouped(f, **parameters):
    def apply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(key, left, right, **parameters)
        finally:
            release()

    return apply


def _cogrouped_plain(f, **parameters):
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right, **parameters) if left.num_rows else _RESULT_ARROW.empty_table()
        finally:
            release()

    return apply


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what remove_repeats makes of the documents table, as counts and digests."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return done.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
