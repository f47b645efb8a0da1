"""Benchmark decontamination: rare seeds find test items in training texts, Smith-Waterman scores them.

An alignment that scores enough shares a known number of the item's words and pairs of neighbouring words with
the text, so of any seeds but so many less it has some: seeds are the item's rarest words and pairs by document
frequency in the corpus, as many as leave no such alignment out, wherever the edits are. Seeds found in a text
open a window that holds any such alignment through them; a window that has too few of all the item's words and pairs
for any such alignment goes, and the words of window and item are aligned locally.
Items come in blocks of bounded size and are held by every executor; texts are read twice a block, once for
frequencies and once for matches, and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .session import durable, freeing, ship

WORDS = 3
#: Seeds that a window must have; each asks for one seed more an item, and spares alignments.
HITS = 4
LEAST_SCORE = 0.5
#: Text of a block of items in bytes; what executors hold is in proportion.
ITEM_BLOCK = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_CELLS = 1 << 20
#: Bytes of text at once; its words and pairs take some 50 times this.
_BLOCK = 1 << 20
#: Seeds of items found in a block of text, looked at together; of more, items are taken in turn.
_FOUND_SEEDS = 1 << 21

_KEEP = np.zeros(256, bool)
_KEEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = True


def _grams(w: tc.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of all pairs of neighbours, and the index of the (first) word of each."""
    (one, at), (two, pair_at) = tc.ngrams(w, 1), tc.ngrams(w, 2)
    return np.concatenate([one, two]), np.concatenate([at, pair_at])


def _found(table: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which grams are in a sorted table, and where it has each first. A bit a table entry, by the first bits of hashes,
    spares the search for most."""
    bits = np.zeros(1 << 20, bool)
    bits[table >> np.uint64(44)] = True
    some = np.flatnonzero(bits[gram >> np.uint64(44)])
    at = np.searchsorted(table, gram[some])
    hit = table[np.minimum(at, len(table) - 1)] == gram[some]
    return some[hit], at[hit]


@dataclass
class Items:
    """A block of test items: ids, word hashes one item after another, the share of the best score that counts, all
    hashes of words and pairs by item, and the seeds: hash, item and place. By item, how many seeds a window must have
    and how many words and pairs."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    least: np.ndarray
    all: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    hits: np.ndarray
    shared: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], n: int, least: float) -> "Items":
        """All words and pairs are seeds. Items of fewer than ``n`` words have to be there word for word."""
        data = [(r[1] or "").encode("utf-8") for r in rows]
        at = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        w = tc.words(tc.Block(0, len(rows), np.frombuffer(b"".join(data), np.uint8), at), keep=_KEEP)
        gram, start = _grams(w)
        order = np.lexsort((start, w.doc[start]))
        gram, start = gram[order], start[order]
        length = np.diff(w.first)
        share = np.where(length < n, 1.0, least)
        shared = np.maximum(np.ceil(MATCH * length * share - 1 - 1e-6), 1).astype(np.int64)
        return cls([r[0] for r in rows], w.hash, w.first, share, gram, gram, w.doc[start], start - w.first[w.doc[start]], np.ones(len(rows), np.int64), shared)

    def seeds(self, frequency: np.ndarray) -> "Items":
        """Only the rarest words and pairs of each item, sorted by hash, such that every alignment that counts has hits.

        m matched words in r runs score 2m - (r - 1) at most and have m words and m - r pairs of the item: together
        the score less 1. All but so many less ``hits`` of the 2L - 1 therefore have ``hits`` of them. What no
        text has counts among the rarest and is not kept.
        """
        length = np.diff(self.first)
        hits = np.minimum(HITS, self.shared)
        order = np.lexsort((self.place, frequency, self.item))
        item = self.item[order]
        rank = np.arange(len(order)) - np.searchsorted(item, item)
        pick = order[(rank < (2 * length - 1 - self.shared + hits)[item]) & (frequency[order] > 0)]
        pick = pick[np.argsort(self.gram[pick], kind="stable")]
        return replace(self, gram=self.gram[pick], item=self.item[pick], place=self.place[pick], hits=hits)

    def some(self, lo: int, hi: int) -> "Items":
        """With the seeds of these items alone."""
        pick = (self.item >= lo) & (self.item < hi)
        return replace(self, gram=self.gram[pick], item=self.item[pick], place=self.place[pick])


def align(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score, and the end (exclusive) in the text and in the item."""
    n = len(texts)
    best, text_end, item_end = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort([len(t) for t in texts], kind="stable")
    lo = 0
    while lo < n:
        hi, width = lo, 0
        while hi < n and (hi == lo or (hi - lo + 1) * len(texts[order[hi]]) <= _CELLS):
            width = max(width, len(texts[order[hi]]))
            hi += 1
        own = order[lo:hi]
        lo = hi
        height = max(len(items[i]) for i in own)
        if not width or not height:
            continue
        t, it = np.zeros((len(own), width), np.uint64), np.ones((len(own), height), np.uint64)
        tl, il = np.array([len(texts[i]) for i in own]), np.array([len(items[i]) for i in own])
        for k, i in enumerate(own):
            t[k, : tl[k]], it[k, : il[k]] = texts[i], items[i]
        beyond = np.arange(width)[None] >= tl[:, None]
        ramp = (-GAP * np.arange(width, dtype=np.int32))[None]
        row = np.zeros((len(own), width), np.int32)
        top = np.zeros(len(own), np.int32)
        for k in range(height):
            step = np.where(t == it[:, k : k + 1], MATCH, MISMATCH).astype(np.int32)
            new = step
            new[:, 1:] += row[:, :-1]
            np.maximum(new, row + GAP, out=new)
            np.maximum(new, 0, out=new)
            new = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps along the text
            new[beyond] = 0
            row = new
            score = row.max(axis=1)
            better = (score > top) & (k < il)
            if better.any():
                top[better] = score[better]
                text_end[own[better]] = row[better].argmax(axis=1) + 1
                item_end[own[better]] = k + 1
        best[own] = top
    return best, text_end, item_end


class _Text:
    """Words of a block and its pairs of neighbours."""

    def __init__(self, block: tc.Block):
        self.w = tc.words(block, keep=_KEEP)
        self.gram, self.start = _grams(self.w)


class _Places:
    """Words and pairs of some documents of a block by hash and place."""

    def __init__(self, text: _Text, docs: np.ndarray):
        self.w = text.w
        some = np.zeros(len(self.w.first) - 1, bool)
        some[docs] = True
        pick = some[self.w.doc[text.start]]
        gram, start = text.gram[pick], text.start[pick]
        self.kinds, number = np.unique(gram, return_inverse=True)
        self.places = np.sort(number * (len(self.w.hash) + 1) + start)

    def has(self, gram: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each word or pair begins among the words a to b, and ends there."""
        k = np.minimum(np.searchsorted(self.kinds, gram), len(self.kinds) - 1)
        n = len(self.w.hash) + 1
        at = np.searchsorted(self.places, k * n + a)
        return (self.kinds[k] == gram) & (at < len(self.places)) & (self.places[np.minimum(at, len(self.places) - 1)] < k * n + b)


def _windows(text: _Text, seeds: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first and end word of every window with enough seeds and enough of all the item's words and pairs."""
    none = (np.empty(0, np.int64),) * 3
    if not len(text.gram) or not len(seeds.gram):
        return none
    hit, lo = _found(seeds.gram, text.gram)
    if not len(hit):
        return none
    count = np.searchsorted(seeds.gram, text.gram[hit], side="right") - lo
    total, n_items = int(count.sum()), len(seeds.ids)
    if total > _FOUND_SEEDS and n_items > 1:  # a phrase of many items, or many items in many texts
        cuts = np.unique(np.linspace(0, n_items, min(n_items, -(-total // _FOUND_SEEDS) + 1) + 1).astype(int)).tolist()
        return tuple(map(np.concatenate, zip(*(_of_items(text, seeds.some(x, y), hit) for x, y in zip(cuts[:-1], cuts[1:])))))
    return _of_items(text, seeds, hit)


def _of_items(text: _Text, seeds: Items, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, none = text.w, (np.empty(0, np.int64),) * 3
    if not len(seeds.gram):
        return none
    hit, lo = _found(seeds.gram, text.gram[among])
    hit = among[hit]
    count = np.searchsorted(seeds.gram, text.gram[hit], side="right") - lo
    which = np.repeat(hit, count)
    s = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    word, item = text.start[which], seeds.item[s]
    doc = w.doc[word]
    length = np.diff(seeds.first)[item]
    slack = np.ceil(MATCH * length * np.maximum(1 - seeds.least[item], 0)).astype(np.int64)  # what is put in costs 1 a word
    a = np.maximum(word - seeds.place[s] - slack, w.first[doc])
    b = np.minimum(word - seeds.place[s] + length + slack, w.first[doc + 1])
    order = np.lexsort((a, item, doc))
    doc, item, a, b, s = doc[order], item[order], a[order], b[order], s[order]
    if not len(s):
        return none
    # of one item in one document windows end in the order in which they begin; those that meet are one
    begin = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (a[1:] > b[:-1]))
    of = np.cumsum(begin) - 1
    begin = np.flatnonzero(begin)
    b = b[np.append(begin[1:], len(of)) - 1]
    distinct = np.bincount(np.unique(of * len(seeds.gram) + s) // len(seeds.gram), minlength=len(begin))
    enough = distinct >= seeds.hits[item[begin]]
    begin, b = begin[enough], b[enough]
    item, a = item[begin], a[begin]
    if not len(item):
        return none
    places = _Places(text, doc[begin])
    # pairs and words of the item in the window, whatever their order
    keep = np.zeros(len(item), bool)
    own_first = 2 * seeds.first - np.arange(len(seeds.first)) + np.append(0, np.cumsum(np.diff(seeds.first) == 0))  # 2L - 1 an item, none where L is 0
    size = np.diff(own_first)[item]
    step = np.append(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 1, _FOUND_SEEDS)), len(item))
    for x, y in zip(step[:-1].tolist(), step[1:].tolist()):
        if x < y:
            n = size[x:y]
            own = np.repeat(np.arange(x, y), n)
            g = seeds.all[np.repeat(own_first[item[x:y]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            has = places.has(g, a[own], b[own])
            keep[x:y] = np.bincount(own - x, has, y - x) >= seeds.shared[item[x:y]]
    return item[keep], a[keep], b[keep]


def matches(block: tc.Block, seeds: Items) -> list[tuple[int, int, float, int, int]]:
    """(document in the block, item, share of the best possible score, first byte, end) of every passage that counts.
    Passages of one item do not overlap; the best goes first."""
    text = _Text(block)
    w = text.w
    waiting = list(zip(*(x.tolist() for x in _windows(text, seeds))))
    out = []
    while waiting:
        texts = [w.hash[x:y] for _, x, y in waiting]
        items = [seeds.words[seeds.first[i] : seeds.first[i + 1]] for i, _, _ in waiting]
        score, t_end, i_end = align(texts, items)
        share = score / (MATCH * np.array([len(i) for i in items]))
        good = np.flatnonzero(share >= seeds.least[[i for i, _, _ in waiting]] - 1e-12).tolist()
        # the same alignment from its end backwards gives where it begins
        _, back, _ = align([texts[k][: t_end[k]][::-1] for k in good], [items[k][: i_end[k]][::-1] for k in good])
        rest = []
        for k, n_back in zip(good, back.tolist()):
            i, x, y = waiting[k]
            first, end = x + int(t_end[k]) - n_back, x + int(t_end[k])
            d = int(w.doc[first])
            out.append((d, i, float(share[k]), int(w.start[first] - block.at[d]), int(w.end[end - 1] - block.at[d])))
            fewest = np.ceil(len(items[k]) * seeds.least[i])  # words that an alignment needs
            rest += [(i, p, q) for p, q in ((x, first), (end, y)) if q - p >= fewest]
        waiting = rest
    return sorted(out)


def _frequencies(held):
    schema = pa.schema([("gram", pa.int64()), ("texts", pa.int64())])

    def run(batches):
        grams = held.value
        count = np.zeros(len(grams), np.int64)
        for batch in batches:
            for b in tc.blocks(batch.column("text"), _BLOCK):
                w = tc.words(b, keep=_KEEP)
                g, start = _grams(w)
                if not len(g) or not len(grams):
                    continue
                hit, at = _found(grams, g)
                pair = np.unique(w.doc[start[hit]] * len(grams) + at)
                count += np.bincount(pair % len(grams), minlength=len(grams))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(count[some])], schema=schema)

    return run


_FOUND = "doc_id bigint, item_id bigint, score double, start bigint, end bigint"


def _find(held):
    names = [f.split()[0] for f in _FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches):
        seeds = held.value
        for batch in batches:
            ids = batch.column("doc_id")
            for b in tc.blocks(batch.column("text"), _BLOCK):
                rows = matches(b, seeds)
                if rows:
                    d, i, *rest = zip(*rows)
                    columns = [ids.take(pa.array([b.lo + x for x in d])), [seeds.ids[x] for x in i], *rest]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _item_blocks(benchmark: DataFrame):
    rows, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        rows.append((r[0], r[1]))
        held += len(r[1] or "") + 64
        if held >= ITEM_BLOCK:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, start and end (bytes of the passage) for every passage of a text that holds an item.

    The score is the best local alignment's share of the item's own (1: all its words in order); ``least`` and more
    counts, and no text that has such a passage is left out; passages of one item in one text do not overlap. Words are
    runs of letters and digits without regard to case of A-Z. Items with fewer than ``n`` words count where they
    are word for word; without any they match nothing. Null texts count as empty; a null doc_id or item_id is given back as null.
    Repeated rows are matched each; an item row repeated under one id gives its matches each time. Other columns are not
    read. Without items or texts the result is empty.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for rows in _item_blocks(benchmark):
        items = Items.of(rows, n, least)
        grams = np.unique(items.gram)
        held = spark.sparkContext.broadcast(grams)  # 16 bytes for each word of a block of items
        counted = docs.select("text").mapInArrow(freeing(_frequencies(held)), "gram bigint, texts bigint").groupBy("gram").agg(F.sum("texts").alias("texts"))
        told = counted.toArrow()  # at most two rows for each word of the block
        held.destroy()
        frequency = np.zeros(len(grams), np.int64)
        frequency[np.searchsorted(grams, told.column("gram").to_numpy().view(np.uint64))] = told.column("texts").to_numpy()
        held = spark.sparkContext.broadcast(items.seeds(frequency[np.searchsorted(grams, items.gram)] if len(grams) else np.empty(0, np.int64)))
        found.append(durable(docs.mapInArrow(freeing(_find(held)), _FOUND)))
        held.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs, with all its columns, without the rows whose doc_id has a text that holds an item; rows of one doc_id go
    together, and those with a null doc_id stay. Null and empty texts hold nothing. Empty tables give what there is."""
    gone = contaminated(docs, benchmark, **parameters).where("doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: passages of the benchmark table in the documents."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start", "end")
