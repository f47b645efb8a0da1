"""Ranked lexical search: an index by document shard, weak-AND over each shard, the shards' heaps merged.

Texts are read once: each task cuts its documents into shards of bounded text and writes one row a shard, with the
postings of all its terms. Items then come in blocks of bounded size. For a block, the terms' document counts are added
up over all shards, and each shard answers every item by WAND: cursors in order of their next document, the first of
them at which the summed largest impacts beat the heap's threshold is the pivot, and documents before it are skipped.
Scores are integers, so the result does not depend on how documents are dealt to shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .session import drop, durable, freeing, ship

TOP = 10
#: Bytes of text in a shard, and documents, so that a place in it fits 16 bits. A longer text is a shard of its own.
SHARD_TEXT, SHARD_DOCS = 16 << 20, 1 << 16
#: Terms of items, with repeats, that are answered at once: 8 bytes each go to every executor.
BLOCK_TERMS = 1 << 20
#: Fixed values of the score: scale of weights, and of the saturated frequency; shares of length in its divisor.
WEIGHT, SCALE, LEAST_M, LENGTH_M, M = 1000, 1_000_000_000, 10, 90, 8

_KEEP = np.zeros(256, dtype=bool)
_KEEP[0x80:] = True
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _KEEP[_first : _last + 1] = True

_INDEX = "n_docs bigint, n_terms bigint, docs binary, lengths binary, terms binary, counts binary, places binary, often binary"
_INDEX_SCHEMA = pa.schema([(f.split()[0], pa.int64() if f.endswith("bigint") else pa.binary()) for f in _INDEX.split(", ")])


def terms_of(block: tc.Block) -> tc.Words:
    """Runs of letters and digits of ASCII and of anything beyond it, A-Z in lower case."""
    return tc.words(block, keep=_KEEP)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), kind)


class Shard:
    """Documents of a shard in ascending order, a null id last, and the postings of every term that they have."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, ids: list[int | None], block: tc.Block) -> None:
        w = terms_of(block)
        self.ids += ids
        self.lengths.append(np.diff(w.first))
        self.hashes.append(w.hash)
        self.bytes += len(block.data)

    def row(self) -> pa.RecordBatch:
        length = np.concatenate(self.lengths)
        ids = np.array([2**63 - 1 if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((np.array([i is None for i in self.ids]), ids))
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order), dtype=np.uint64)
        doc = np.repeat(place, length).astype(np.uint16)
        h = np.concatenate(self.hashes)
        by = np.lexsort((doc, h))
        h, doc = h[by], doc[by]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(fresh)
        often = np.diff(np.append(at, len(h))).astype(np.uint32)
        h, doc = h[at], doc[at]
        term = np.ones(len(h), bool)
        term[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(term)
        known = np.array([i is not None for i in self.ids])[order]
        columns = [int((length > 0).sum()), int(length.sum()), _pack(np.concatenate([ids[order], known])), _pack(length[order].astype(np.int64)), _pack(h[first]), _pack(np.diff(np.append(first, len(h)))), _pack(doc), _pack(often)]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _INDEX_SCHEMA)], schema=_INDEX_SCHEMA)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = Shard()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for b in tc.blocks(batch.column("text")):
            if shard.ids and (shard.bytes + len(b.data) > SHARD_TEXT or len(shard.ids) + len(b) > SHARD_DOCS):
                yield shard.row()
                shard = Shard()
            for lo in range(0, len(b), SHARD_DOCS):  # texts without bytes may be any number
                if len(shard.ids) + min(SHARD_DOCS, len(b) - lo) > SHARD_DOCS:
                    yield shard.row()
                    shard = Shard()
                hi = min(lo + SHARD_DOCS, len(b))
                shard.add(ids[b.lo + lo : b.lo + hi], tc.Block(0, hi - lo, b.data[b.at[lo] : b.at[hi]], b.at[lo : hi + 1] - b.at[lo]))
    if shard.ids:
        yield shard.row()


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard of documents, in the shared folder: ids, lengths, terms and their postings."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return durable(docs.mapInArrow(freeing(_build), _INDEX))


def _held(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``terms`` of those ``wanted`` that are there, and which these are."""
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    there = np.flatnonzero(terms[at] == wanted) if len(terms) else np.empty(0, np.int64)
    return at[there], there


def _frequencies(wanted):
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                at, there = _held(_unpack(terms, np.uint64), wanted.value)
                total[there] += _unpack(counts, np.int64)[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted.value[some].view(np.int64)), pa.array(total[some])], schema=schema)

    return run


def wand(lists: list[tuple[int, list[int], list[int]]], top: int, told: list[int] | None = None) -> list[tuple[int, int]]:
    """The ``top`` best (score, -document) of a shard, best first.

    lists: of each term its largest impact, its documents in ascending order, and its impact on each. A document
    that only equals the threshold comes after those in the heap, so it is passed over like a lower one. ``told``
    gets the number of documents that were scored.
    """
    cursors = [[docs[0], bound, docs, impacts, 0] for bound, docs, impacts in lists if docs]
    heap: list[tuple[int, int]] = []
    threshold = scored = 0
    while True:
        cursors.sort(key=lambda c: c[0])
        sum_of_bounds = 0
        for p, c in enumerate(cursors):
            sum_of_bounds += c[1]
            if sum_of_bounds > threshold:
                break
        else:
            break
        pivot = cursors[p][0]
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                at = c[4]
                score += c[3][at]
                c[4] = at = at + 1
                c[0] = c[2][at] if at < len(c[2]) else -1
            scored += 1
            if score > threshold:
                if len(heap) < top:
                    heappush(heap, (score, -pivot))
                else:
                    heapreplace(heap, (score, -pivot))
                if len(heap) == top:
                    threshold = heap[0][0]
        else:
            for c in cursors[:p]:
                if c[0] < pivot:
                    c[4] = at = bisect_left(c[2], pivot, c[4] + 1)
                    c[0] = c[2][at] if at < len(c[2]) else -1
        if cursors[0][0] < 0 or any(c[0] < 0 for c in cursors):
            cursors = [c for c in cursors if c[0] >= 0]
    if told is not None:
        told.append(scored)
    return sorted(heap, reverse=True)


_FOUND = "item_id bigint, doc_id bigint, score bigint"


def _search(held, top: int):
    schema = pa.schema([(f.split()[0], pa.int64()) for f in _FOUND.split(", ")])

    def run(batches):
        items, wanted, weights, n, total = held.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, counts, places, often = (batch.column(c)[row] for c in ("docs", "lengths", "terms", "counts", "places", "often"))
                length = _unpack(lengths, np.int64)
                divisor = M * (LEAST_M + (LENGTH_M * length * n) // total) if total else np.zeros(0, np.int64)
                packed = _unpack(ids, np.int64)
                doc_id, known = packed[: len(length)], packed[len(length) :].astype(bool)
                counts = _unpack(counts, np.int64)
                first = np.cumsum(counts) - counts
                at, there = _held(_unpack(terms, np.uint64), wanted)
                places, often = _unpack(places, np.uint16), _unpack(often, np.uint32)
                lists: dict[int, tuple[int, list[int], list[int]]] = {}
                for a, t in zip(at.tolist(), there.tolist()):
                    span = slice(first[a], first[a] + counts[a])
                    place, tf = places[span], often[span].astype(np.int64)
                    impact = weights[t] * ((SCALE * tf) // (1000 * tf + divisor[place]))
                    lists[t] = (int(impact.max()), place.tolist(), impact.tolist())
                out: list[tuple] = []
                for item, own in items:
                    best = wand([lists[t] for t in own if t in lists], top)
                    out += [(item, int(doc_id[-d]) if known[-d] else None, score) for score, d in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def _item_terms(batches):
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.int64())])
    for batch in batches:
        for b in tc.blocks(batch.column("text")):
            w = terms_of(b)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(b.lo, len(b)).take(pa.array(w.doc)), pa.array(w.hash.view(np.int64))], schema=schema)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items with their different terms, in blocks; rows that share an id are one item."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = items.mapInArrow(freeing(_item_terms), "item_id bigint, term bigint").groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    block, held = [], 0
    for r in terms.toLocalIterator():
        block.append((r["item_id"], np.sort(np.array(r["terms"], np.int64).view(np.uint64))))
        held += len(r["terms"])
        if held >= BLOCK_TERMS:
            yield block
            block, held = [], 0
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents with a score above 0.

    docs: doc_id, text. items: item_id, text. Ranks begin at 1 and are unique; equal scores are in ascending order of
    doc_id, a null one last. Every row of docs is a document of its own, also where rows share a doc_id; rows of items
    that share an item_id (or have none) are one item with the terms of all. Null and empty texts have no terms: such a
    document is never found and does not count, such an item finds nothing. Empty tables give no rows. Other columns
    are not read. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    n, total = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    found = []
    for block in _item_blocks(items):
        wanted = np.unique(np.concatenate([t for _, t in block]))
        held = spark.sparkContext.broadcast(wanted)  # 8 bytes for each term of a block of items
        told = index.select("terms", "counts").mapInArrow(freeing(_frequencies(held)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        held.destroy()
        df = np.zeros(len(wanted), np.int64)
        df[np.searchsorted(wanted, told.column("term").to_numpy().view(np.uint64))] = told.column("df").to_numpy()
        weights = np.array([math.floor(WEIGHT * math.log((2 * n + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
        block = [(i, np.searchsorted(wanted, t).tolist()) for i, t in block]
        held = spark.sparkContext.broadcast((block, wanted, weights, n, total))
        heaps = index.mapInArrow(freeing(_search(held, top)), _FOUND)
        # only the best of each item leave a task: the window's limit is applied before the shuffle, too
        best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.append(durable(heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)))
        held.destroy()
    drop(index)
    if not found:
        found = [spark.createDataFrame([], f"{_FOUND}, rank int")]
    return reduce(DataFrame.unionByName, found).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the ten best documents for every benchmark item."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same scores in SQL, every document of every item.
SQL = """
WITH
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
t AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s WHERE term IN (SELECT term FROM i) GROUP BY term, s.n),
m AS (SELECT i.item_id, t.row, t.doc_id, CAST(sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * t.n * s.n) // s.l)))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN t USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM m WHERE score > 0) WHERE rank <= 10"""
