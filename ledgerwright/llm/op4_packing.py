"""Vector bin packing of token sequences for training.

Sequences have simultaneous limits on tokens, segments and loss-bearing tokens. An open sequence
takes, among the items that fit, the one whose demand has the largest dot product with what is left
of each limit, so items heavy in the scarcest-used resources go where those are plentiful. Items with
equal demands are one class, and a choice costs one product over the classes.

With ``cut``, items longer than what is left may be cut: the last free segment, or a gap that no item
fits, takes the front of the longest item, and a sequence that stays short is divided into sequences
whose lengths are powers of two. These are not padded, so nothing is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import freeing, ship
from .tokens import encoded, encoder, vocabulary_path

#: Tokens packed together: a task's texts are packed in windows of about this many.
WINDOW_TOKENS = 1 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit has to be at least 1")


class _Classes:
    """Waiting items by (tokens, loss): a stack of items for each pair."""

    def __init__(self, tokens: np.ndarray, loss: np.ndarray, limits: Limits):
        self.limits = limits
        demand = np.column_stack([tokens, loss])
        kinds, which = np.unique(demand, axis=0, return_inverse=True)
        which = which.ravel()
        self.tokens, self.loss = kinds[:, 0].astype(float), kinds[:, 1].astype(float)
        self.place = {tuple(k): i for i, k in enumerate(kinds.tolist())}
        order = np.argsort(which, kind="stable")[::-1]
        self.stack: list[list[int]] = [[] for _ in kinds]
        for i in order.tolist():
            self.stack[which[i]].append(i)
        self.waiting = np.array([len(s) for s in self.stack])
        self.left = int(self.waiting.sum())

    def best(self, room: tuple[int, int, int]) -> int | None:
        """The class that fits with the largest dot product of demand and room, in shares of the limits."""
        lim = self.limits
        fits = (self.waiting > 0) & (self.tokens <= room[0]) & (self.loss <= room[2])
        if not fits.any():
            return None
        score = self.tokens * (room[0] / lim.tokens**2) + room[1] / lim.segments**2 + self.loss * (room[2] / lim.loss**2)
        return int(np.argmax(np.where(fits, score, -1.0)))

    def longest(self) -> int:
        return int(np.argmax(np.where(self.waiting > 0, self.tokens, -1.0)))

    def take(self, kind: int) -> int:
        self.waiting[kind] -= 1
        self.left -= 1
        return self.stack[kind].pop()

    def put(self, item: int, tokens: int, loss: int) -> None:
        i = self.place.get((tokens, loss))
        if i is None:
            i = self.place[(tokens, loss)] = len(self.stack)
            self.tokens, self.loss = np.append(self.tokens, tokens), np.append(self.loss, loss)
            self.waiting = np.append(self.waiting, 0)
            self.stack.append([])
        self.stack[i].append(item)
        self.waiting[i] += 1
        self.left += 1


def pack(tokens: np.ndarray, loss: np.ndarray | None, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length), items by their index.

    loss: loss-bearing tokens of each item; None: all of them. Only then may items be cut, and their
    pieces have the loss of their length. Without ``cut`` an item beyond a limit is an error; items
    without tokens are left out.
    """
    tokens = np.asarray(tokens, np.int64)
    if cut and loss is not None:
        raise ValueError("items whose tokens differ in loss are not cut")
    most = min(limits.tokens, limits.loss) if loss is None else limits.tokens
    loss_of = tokens if loss is None else np.asarray(loss, np.int64)
    if (loss_of > tokens).any() or (loss_of < 0).any() or (tokens < 0).any():
        raise ValueError("loss-bearing tokens are some of an item's tokens")
    if not cut and ((tokens > most).any() or (loss_of > limits.loss).any()):
        raise ValueError("an item is beyond the limits")
    out: list[list[tuple[int, int, int]]] = []
    offset = np.zeros(len(tokens), np.int64)
    if cut:  # whole sequences first: what is left of each item is shorter than a sequence
        for i in np.flatnonzero(tokens >= most).tolist():
            for k in range(int(tokens[i]) // most):
                out.append([(i, k * most, most)])
            offset[i] = tokens[i] // most * most
    rest = tokens - offset
    items = np.flatnonzero(rest > 0)
    bag = _Classes(rest[items], rest[items] if loss is None else loss_of[items], limits)
    short: list[list[tuple[int, int, int]]] = []
    while bag.left:
        room, now = [limits.tokens, limits.segments, limits.loss], []
        while bag.left and min(room) > 0:
            kind = None
            gap = min(room[0], room[2])
            if cut and room[1] == 1:
                kind = bag.longest()
            if kind is None:
                kind = bag.best(tuple(room))
            if kind is None:
                if not cut:
                    break
                kind = bag.longest()
            need = int(bag.tokens[kind])
            j = bag.take(kind)
            i = int(items[j])
            if cut and need > gap:
                bag.put(j, need - gap, need - gap)
                need = gap
            now.append((i, int(offset[i]), need))
            offset[i] += need
            room[0] -= need
            room[1] -= 1
            room[2] -= need if loss is None else int(bag.loss[kind])
        total = sum(p[2] for p in now)
        (short if cut and total < limits.tokens and total & (total - 1) else out).append(now)
    for now in short:
        out += _halved(now)
    return out


def _halved(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Divide a short sequence into sequences with lengths of powers of two, the longest first."""
    total, out, k = sum(p[2] for p in pieces), [], 0
    waiting = list(reversed(pieces))
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        now = []
        while size:
            i, start, n = waiting.pop()
            k = min(n, size)
            now.append((i, start, k))
            size -= k
            if n > k:
                waiting.append((i, start + k, n - k))
        out.append(now)
    return out


def padded_length(n: int, most: int) -> int:
    """Length of a sequence of n tokens with its padding: none at a power of two, else up to the limit."""
    return n if n & (n - 1) == 0 else most


_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_to", pa.int64()), ("ids", pa.binary())])
PACKED = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_to bigint, ids binary"


def _pack_window(doc_ids: list, flats: list[np.ndarray], sizes: list[np.ndarray], limits: Limits, base: int):
    flat, size = np.concatenate(flats).astype("<u4"), np.concatenate(sizes)
    at = np.cumsum(size) - size
    found = pack(size, None, limits, cut=True)
    rows = [(p[0], p[1], p[2], s) for s, now in enumerate(found) for p in now]
    item, start, length, seq = (np.array(c, np.int64) for c in zip(*rows))
    first = np.append(True, seq[1:] != seq[:-1])
    total = np.cumsum(length) - length
    offset = total - np.repeat(total[first], np.diff(np.append(np.flatnonzero(first), len(seq))))
    fill = np.bincount(seq, weights=length).astype(np.int64)
    padded = np.where(fill & (fill - 1) == 0, fill, limits.tokens)
    ids = pa.array([doc_ids[i] for i in item.tolist()], pa.int64())
    body = [flat[a : a + n].tobytes() for a, n in zip((at[item] + start).tolist(), length.tolist())]
    columns = [ids, start, length, size[item], base + seq, offset, padded[seq], pa.array(body, pa.binary())]
    for lo in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 20_000]) if isinstance(c, np.ndarray) else c.slice(lo, 20_000) for c in columns], schema=_PACKED)


def _packer(path: str, end_id: int, limits: Limits):
    def run(batches):
        ids, flats, sizes, held, windows = [], [], [], 0, 0
        part = TaskContext.get().partitionId()
        for docs, flat, size in encoded(batches, path, end_id):
            ids += docs.to_pylist()
            flats.append(flat.astype(np.uint32))
            sizes.append(size)
            held += len(flat)
            if held >= WINDOW_TOKENS:
                yield from _pack_window(ids, flats, sizes, limits, (part << 40) + (windows << 24))
                ids, flats, sizes, held, windows = [], [], [], 0, windows + 1
        if ids:
            yield from _pack_window(ids, flats, sizes, limits, (part << 40) + (windows << 24))

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits()) -> DataFrame:
    """Encode texts and pack them, cutting freely, into sequences within the limits.

    Returns a row for each piece: doc_id, start (ids of its document before it), length, doc_tokens,
    sequence_id, offset (in the sequence), padded_to and ids (binary, little-endian unsigned 32-bit).
    Null and empty texts are just the end id. Rows with equal or null doc_id are documents of their own.
    Other columns are not read. No rows are shuffled: each task packs what it reads in windows, so
    sequences stay independent of all other tasks and a repeated task repeats only its own.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(freeing(_packer(vocabulary, end_id, limits), encodes=True), PACKED)


def _pack_examples(limits: Limits):
    schema = pa.schema([("example_id", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.int64()), ("loss_tokens", pa.int64())])

    def run(batches):
        part, windows, held = TaskContext.get().partitionId(), 0, []

        def place():
            ids = [i for b in held for i in b.column("example_id").to_pylist()]
            tokens, loss = (np.concatenate([b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for b in held]) for c in ("tokens", "loss_tokens"))
            rows = []
            for s, now in enumerate(pack(tokens, loss, limits, cut=False)):
                at = 0
                for i, _, n in now:
                    rows.append((ids[i], (part << 40) + (windows << 24) + s, at, n, int(loss[i])))
                    at += n
            cols = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

        n = 0
        for b in batches:
            held.append(b)
            n += sum(x or 0 for x in b.column("tokens").to_pylist())
            if n >= WINDOW_TOKENS:
                yield place()
                held, n, windows = [], 0, windows + 1
        if held:
            yield place()

    return run


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Place whole instruction examples (example_id, tokens, loss_tokens) under all three limits.

    Returns example_id, sequence_id, offset, tokens and loss_tokens. Examples without tokens have no
    place; null counts are 0; one beyond a limit is an error, as cutting it would part a prompt from its answer.
    Equal and null example_ids are examples of their own. Other columns are not read; an empty table gives no rows.
    """
    ship(examples.sparkSession)
    columns = [F.col(c).cast("bigint").alias(c) for c in ("example_id", "tokens", "loss_tokens")]
    return examples.select(*columns).mapInArrow(freeing(_pack_examples(limits)), "example_id bigint, sequence_id bigint, offset bigint, tokens bigint, loss_tokens bigint")


def _turn_tokens(path: str):
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("n", pa.int64())])

    def run(batches):
        e = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                sizes = e.encode([t or "" for t in part.column("text").to_pylist()])[1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "role")), pa.array(sizes + 1)], schema=schema)

    return run


def conversation_examples(conversations: DataFrame, vocabulary: str, limits: Limits = Limits(), learned: str = "assistant") -> DataFrame:
    """Instruction examples of conversations (conv_id, turn, role, text): example_id, conv_id, tokens and loss_tokens.

    A turn has its text's tokens and an end id; turns of the role ``learned`` bear loss, all their tokens. A conversation
    is one example where half the limits on tokens and loss hold it, and else several of consecutive turns, of which
    each is within the limits; a turn longer than half a limit is cut. Nothing is left out: null and empty texts are an end id, a null role
    bears no loss, turns of equal number follow one another, and turns with a null conv_id are one conversation. Other
    columns are not read. A conversation's turns are put in order by one sort, which spills.
    """
    ship(conversations.sparkSession)
    columns = [F.col(c).cast(t).alias(c) for c, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))]
    turns = conversations.select(*columns).mapInArrow(freeing(_turn_tokens(vocabulary), encodes=True), "conv_id bigint, turn bigint, role string, n bigint")
    bears = F.coalesce(F.col("role") == learned, F.lit(False))
    half_tokens, half_loss = max(1, limits.tokens // 2), max(1, limits.loss // 2)
    most = F.when(bears, F.lit(min(half_tokens, half_loss))).otherwise(F.lit(half_tokens))
    cut = turns.select("conv_id", "turn", "role", "n", most.alias("most"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most))).alias("k"))
    size = F.least(F.col("most"), F.col("n") - F.col("k") * F.col("most"))
    parts = cut.select("conv_id", "turn", "role", "n", "k", size.alias("tokens"), F.when(bears, size).otherwise(F.lit(0)).alias("loss_tokens"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "n", "k").rowsBetween(Window.unboundedPreceding, -1)
    # what begins in one half of a limit ends within the limit
    at = lambda c, half: F.floor(F.coalesce(F.sum(c).over(before), F.lit(0)) / half)
    placed = parts.select("conv_id", "tokens", "loss_tokens", at("tokens", half_tokens).alias("p"), at("loss_tokens", half_loss).alias("q"))
    whole = placed.groupBy("conv_id", "p", "q").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
    return whole.select(F.xxhash64("conv_id", "p", "q").alias("example_id"), "conv_id", "tokens", "loss_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the documents as byte-level ids in sequences of at most 2048."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = pack_documents(docs, vocabulary_path("byte_bpe_50k.json"), end_id=1, limits=Limits(2048, 64, 2048))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")
