"""Toxicity by class-conditional Kneser-Ney models over letters.

Toxic and ordinary texts each have an interpolated Kneser-Ney model of the next letter after the five before
it. Both back off to one shared model of letter pairs, counted over the whole corpus, labelled or not. What
neither class has seen therefore counts for neither, and rare expressions are drawn to what is common to both.

Counting covers every text. Tasks send distinct six-letter strings with their counts. A string is dealt to a shard
by its fourth and fifth letters, which its context and all shorter strings that it backs off to share, so that a shard
derives lower orders (numbers of distinct letters before a string), probabilities and backing off by itself. Counts
stay in a table of shards: neither the driver nor an executor ever holds them all. To score texts, each block of them
asks every shard for its distinct strings, and what the shards answer goes back to the block. A document's score is a
calibrated logistic function of the two length-normalised log-likelihoods' difference, over the whole text and over its
strongest words. Calibration uses labelled documents scored by models that were fitted without them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .boosting import sigmoid
from .session import drop, durable, freeing, release, ship

ORDER = 6
#: Text of a shard in bytes, and the fewest and most shards.
SHARD_TEXT, SHARDS = 16 << 20, (16, 4096)
#: Text of a block that asks the shards in bytes: a share of the corpus, within these bounds (or one longer text).
BLOCK_TEXT, BLOCKS = (1 << 18, 16 << 20), 64
#: Blocks that one group of questions to a shard comes from, at most; of more a shard is looked up in several tasks.
ASKING = 4096
#: Labels up to this number are sent to all executors (16 bytes each); more are joined by a shuffle.
MOST_SENT = 1 << 21
#: Where counts say nothing of it; else the share of what occurs once, as usual.
DISCOUNT = 0.75
#: Labelled documents that calibrate the score, at most; all labelled documents are counted.
CALIBRATION = 6000
#: Orders up to this one are shared by the classes.
BASE = 2
_FOLDS = ("toxic_a", "plain_a", "toxic_b", "plain_b", "rest")
#: Folds of the toxic and of the plain texts of a model: either half of the labels, and both.
_MODELS = (((0,), (1,)), ((2,), (3,)), ((0, 2), (1, 3)))
_U = np.uint64

#: Letters stay, digits are alike, all else is a blank.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x30:0x3A] = 0x30


def grams(block: tc.Block) -> np.ndarray:
    """For every byte of the block the six letters that end there, as a number; blanks stand before a document."""
    x = _FOLD[block.data].astype(_U)
    key = x.copy()
    for j in range(1, ORDER):
        key[j:] |= x[:-j] << _U(8 * j)
    for i in range(ORDER - 1):  # the first letters of documents
        at = block.at[:-1] + i
        at = at[at < block.at[1:]]
        key[at] = key[at] & _U((1 << (8 * (i + 1))) - 1) | _U(sum(0x20 << (8 * j) for j in range(i + 1, ORDER)))
    return key


def _middle(key: np.ndarray) -> np.ndarray:
    """The two letters before the last one."""
    return (key >> _U(8)) & _U(0xFFFF)


def _shard_of(middle: np.ndarray, shards: int) -> np.ndarray:
    return (tc.mix(middle + _U(1)) % _U(shards)).astype(np.int64)


def _merged(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(counts[order], first, axis=0, dtype=counts.dtype) if len(key) else counts


@lru_cache(maxsize=1)
def _zstandard() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    return _zstandard()[0].compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(_zstandard()[1].decompress(x), kind)


_PART = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_FLUSH = 1_000_000
#: Bytes of text at once; a letter takes some 60 bytes of temporary arrays.
_BLOCK = 1 << 19


def _count(shards: int):
    """Distinct strings of the task with their counts by fold, dealt to shards."""

    def run(batches):
        keys, counts, held = [], [], 0

        def flush():
            k, c = _merged(np.concatenate(keys), np.concatenate(counts))
            shard = _shard_of(_middle(k), shards)
            order = np.argsort(shard, kind="stable")
            k, c, shard = k[order], c[order], shard[order]
            cut = np.searchsorted(shard, np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            delta = lambda x: np.diff(x, prepend=_U(0))  # noqa: E731  keys are sorted within a shard
            rows = [(s, _pack(delta(k[cut[s] : cut[s + 1]])), _pack(np.ascontiguousarray(c[cut[s] : cut[s + 1]].T, np.uint32))) for s in some]
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _PART)], schema=_PART)

        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for b in tc.blocks(batch.column("text"), _BLOCK):
                if not len(b.data):
                    continue
                g = grams(b)
                of = np.repeat(fold[b.lo : b.hi], np.diff(b.at))
                for f in np.unique(of).tolist():
                    k, n = np.unique(g[of == f], return_counts=True)
                    c = np.zeros((len(k), len(_FOLDS)), np.uint32)
                    c[:, f] = n
                    keys.append(k)
                    counts.append(c)
                    held += len(k)
                if held > _FLUSH:
                    k, c = _merged(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k], [c], len(k)
                    if held > _FLUSH // 2:
                        yield flush()
                        keys, counts, held = [], [], 0
        if keys:
            yield flush()

    return run


_COUNTED = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("pairs", pa.binary()), ("often", pa.binary())])
COUNTED = "shard int, keys binary, counts binary, pairs binary, often binary"
_OFTEN = 16


def _lower(key: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings without their first letter, and how many distinct letters stand before each."""
    return _merged(key & _U((1 << (8 * (order - 1))) - 1), (n > 0).astype(np.int64))


def _by_class(count: np.ndarray) -> np.ndarray:
    """Columns: toxic and plain of every model."""
    return np.column_stack([count[:, list(folds)].sum(axis=1, dtype=np.int64) for model in _MODELS for folds in model])


def _levels(key: np.ndarray, count: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order, the strings of labelled texts and their counts by class and model."""
    n, out = _by_class(count), {}
    some = n.any(axis=1)
    key, n = key[some], n[some]
    for order in range(ORDER, BASE, -1):
        out[order] = key, n
        key, n = _lower(key, n, order)
    return out


def _gather(table: pa.Table) -> pa.Table:
    """A shard's strings with their counts; the distinct three-letter strings by their last two letters; and by order and
    class how many strings have a count of 1, 2, ... (_OFTEN: and more)."""
    keys, counts = [], []
    for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
        k = np.cumsum(_unpack(k, _U), dtype=_U)
        keys.append(k)
        counts.append(_unpack(c, np.uint32).reshape(len(_FOLDS), len(k)).T)
    key, count = _merged(np.concatenate(keys), np.concatenate(counts))
    three = np.unique(key & _U(0xFFFFFF))
    pair, number = np.unique(three & _U(0xFFFF), return_counts=True)
    often = np.zeros((ORDER + 1, 2 * len(_MODELS), _OFTEN + 1), np.int64)
    for order, (_, n) in _levels(key, count).items():
        for c in range(n.shape[1]):
            often[order, c] = np.bincount(np.minimum(n[:, c], _OFTEN), minlength=_OFTEN + 1)
    row = (table.column("shard")[0].as_py(), _pack(np.diff(key, prepend=_U(0))), _pack(np.ascontiguousarray(count.T, np.uint32)), np.column_stack([pair, number]).astype(np.int64).tobytes(), often.tobytes())
    return pa.table([pa.array([x], t.type) for x, t in zip(row, _COUNTED)], schema=_COUNTED)


def _shared_pairs(rows: list) -> np.ndarray:
    """Probability of each letter pair's second letter in the model that both classes share, by the pair's number."""
    number = np.zeros(1 << 16)
    for r in rows:
        pair, n = np.frombuffer(r["pairs"], np.int64).reshape(-1, 2).T
        number[pair] += n  # a three-letter string is in one shard
    number = number.reshape(256, 256)  # first letter, second letter
    letters = (number > 0).sum(axis=0)
    one = (letters + 0.5) / (letters.sum() + 128)
    total, kinds = number.sum(axis=1), (number > 0).sum(axis=1)
    free = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return (np.maximum(number - DISCOUNT, 0) / np.maximum(total, 1)[:, None] + free[:, None] * one[None]).ravel()


def _probabilities(levels: dict[int, tuple[np.ndarray, np.ndarray]], pairs: np.ndarray, discount: np.ndarray, columns: tuple[int, int]):
    """By order: strings, whether either class has each, the difference of the two classes' log-probabilities; contexts
    and the difference of the logarithms of what they leave to the next shorter string."""
    p, below = None, None
    for order in range(BASE + 1, ORDER + 1):
        key, n = levels[order][0], levels[order][1][:, list(columns)].astype(np.float64)
        context, of = np.unique(key >> _U(8), return_inverse=True)
        suffix = key & _U((1 << (8 * (order - 1))) - 1)
        low = np.repeat(pairs[suffix.astype(np.int64)][:, None], 2, axis=1) if p is None else p[np.searchsorted(below, suffix)]
        d = discount[order, list(columns)]
        total = np.stack([np.bincount(of, n[:, c], len(context)) for c in (0, 1)], axis=1)
        kinds = np.stack([np.bincount(of, n[:, c] > 0, len(context)) for c in (0, 1)], axis=1)
        free = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(np.maximum(n - d, 0) / np.maximum(total, 1)[of] + free[of] * low, 1e-12)
        below = key
        yield order, key, n.any(axis=1), np.log(p[:, 0]) - np.log(p[:, 1]), context, np.log(free[:, 0]) - np.log(free[:, 1])


def _tables(keys: bytes, counts: bytes, pairs: np.ndarray, discount: np.ndarray, models: tuple[int, ...]) -> list[dict]:
    """Of a shard, by model and order: strings that labelled texts have with the difference of the classes' log-probabilities;
    contexts with what they add to that of the next shorter string."""
    key = np.cumsum(_unpack(keys, _U), dtype=_U)
    levels = _levels(key, _unpack(counts, np.uint32).reshape(len(_FOLDS), len(key)).T)
    return [{order: (key[seen], full[seen], context, left) for order, key, seen, full, context, left in _probabilities(levels, pairs, discount, (2 * m, 2 * m + 1))} for m in models]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where among sorted keys those wanted are, and which of them there are."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _differences(table: dict, g: np.ndarray) -> np.ndarray:
    """Of each string the difference of its last letter's log-probabilities in the two classes."""
    d, rest = np.zeros(len(g)), np.arange(len(g))
    for order in range(ORDER, BASE, -1):
        keys, value, context, left = table[order]
        at, hit = _found(keys, g)
        d[rest[hit]] += value[at[hit]]
        rest, g = rest[~hit], g[~hit]
        at, hit = _found(context, g >> _U(8))
        d[rest[hit]] += left[at[hit]]
        g = g & _U((1 << (8 * (order - 1))) - 1)
    return d


@dataclass
class Counted:
    """Counts of all shards, and what is the same for all of them. None: there is nothing to tell classes apart by."""

    table: DataFrame
    pairs: np.ndarray
    discount: np.ndarray
    shards: int


def _distinct(*keys: np.ndarray) -> np.ndarray:
    key = np.sort(np.concatenate(keys))
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def _payloads(at: int, most: int, blocks: int):
    """Rows in pieces of about ``most`` bytes of text, compressed, dealt to blocks; column ``at`` has the texts."""

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in held:
                    out.write_batch(x)
            block = int(tc.mix(np.array([part << 32 | number], _U))[0]) % blocks
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

        for batch in batches:
            for b in tc.blocks(batch.column(at), most):
                if held and size + len(b.data) > most:
                    yield flush()
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(b.lo, len(b)))
                size += len(b.data) + 64 * len(b)
        if held:
            yield flush()

    return run


def _read(payloads: pa.Table):
    for x in payloads.column("rows"):
        yield from pa.ipc.open_stream(x.as_buffer())


_ASKED = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])
ASKED = "shard int, part bigint, block bigint, keys binary"
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("values", pa.binary())])
ANSWER = "block bigint, shard int, values binary"


def _by_shard(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by shard, and where each shard's begin."""
    shard = _shard_of(_middle(key), shards)
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _asked(at: int, shards: int):
    """A block's distinct strings, to the shards that have them."""

    def run(key, payloads: pa.Table) -> pa.Table:
        block, found = key[0].as_py(), []
        for batch in _read(payloads):
            for b in tc.blocks(batch.column(at), _BLOCK):
                found.append(_distinct(grams(b)))
            if len(found) > 16:
                found = [_distinct(*found)]
        keys = _distinct(*found)
        order, cut = _by_shard(keys, shards)
        keys, rows = keys[order], []
        for s in np.flatnonzero(np.diff(cut)).tolist():
            rows.append((s, block // ASKING, block, _pack(np.diff(keys[cut[s] : cut[s + 1]], prepend=_U(0)))))
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows), _ASKED)], schema=_ASKED) if rows else _ASKED.empty_table()

    return _freed(run)


def _answered(pairs: np.ndarray, discount: np.ndarray, models: tuple[int, ...]):
    """A shard's answers: of each string asked for, one model after another, the classes' difference."""

    def run(key, asked: pa.Table, counted: pa.Table) -> pa.Table:
        if not asked.num_rows or not counted.num_rows:
            return _ANSWER.empty_table()
        tables = _tables(counted.column("keys")[0].as_py(), counted.column("counts")[0].as_py(), pairs, discount, models)
        values, held, size = [], [], 0

        def look():
            g = np.concatenate(held)
            d = np.stack([_differences(t, g) for t in tables]).astype(np.float16)
            cut = np.cumsum([0, *map(len, held)])
            values.extend(_pack(np.ascontiguousarray(d[:, a:b])) for a, b in zip(cut[:-1], cut[1:]))

        for x in asked.column("keys"):
            held.append(np.cumsum(_unpack(x.as_py(), _U), dtype=_U))
            size += len(held[-1])
            if size > _FLUSH // 4:
                look()
                held, size = [], 0
        if held:
            look()
        return pa.table([asked.column("block"), pa.array([key[0].as_py()] * asked.num_rows, pa.int32()), pa.array(values, pa.binary())], schema=_ANSWER)

    return _freed(run)


def _featured(at: int, shards: int, models: int, then, schema: pa.Schema | None):
    """What ``then`` makes of a block's rows and their features by each model."""

    def run(payloads: pa.Table, answers: pa.Table) -> pa.Table:
        batches, parts = list(_read(payloads)), []
        for batch in batches:
            for b in tc.blocks(batch.column(at), _BLOCK):
                g = grams(b)
                order = np.argsort(g)
                key = g[order]
                new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
                of = np.empty(len(g), np.int32)
                of[order] = np.cumsum(new) - 1
                parts.append((key[new], of))
        keys = _distinct(*(k for k, _ in parts)) if parts else np.empty(0, _U)
        order, cut = _by_shard(keys, shards)
        values = np.zeros((models, len(keys)), np.float32)
        for s, x in zip(answers.column("shard").to_pylist(), answers.column("values")):
            values[:, order[cut[s] : cut[s + 1]]] = _unpack(x.as_py(), np.float16).reshape(models, -1)
        out, parts = [], iter(parts)
        for batch in batches:
            by: list[list[np.ndarray]] = [[] for _ in range(models)]
            for b in tc.blocks(batch.column(at), _BLOCK):
                key, of = next(parts)
                d = values[:, np.searchsorted(keys, key)]
                for m in range(models):
                    by[m].append(features(d[m][of], b))
            out.append(then(batch, [np.concatenate(x) if x else np.zeros((0, N_FEATURES)) for x in by]))
        return pa.Table.from_batches(out, schema or out[0].schema)

    return _freed(run)


def _freed(f: Callable) -> Callable:
    """f, giving free memory back when a group is done."""
    if f.__code__.co_argcount == 3:

        def run(key, left, right):
            try:
                return f(key, left, right)
            finally:
                release()

    else:

        def run(left, right):
            try:
                return f(left, right)
            finally:
                release()

    return run


def _scanned(docs: DataFrame, counted: Counted, models: tuple[int, ...], then, schema, arrow: pa.Schema | None = None) -> DataFrame:
    """Rows of docs, by blocks, with the features of their texts by each of the models, as ``then`` makes rows of them."""
    at = docs.columns.index("text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    each = min(max(BLOCK_TEXT[0], size // BLOCKS), BLOCK_TEXT[1])
    blocks = max(1, -(-size // each))
    rows = docs.mapInArrow(freeing(_payloads(at, each // 8, blocks)), "block bigint, rows binary")  # both uses share one shuffle
    asked = rows.groupBy("block").applyInArrow(_asked(at, counted.shards), ASKED)
    table = counted.table.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((blocks - 1) // ASKING).cast("bigint"))).alias("part"), "keys", "counts")
    answers = asked.groupBy("shard", "part").cogroup(table.groupBy("shard", "part")).applyInArrow(_answered(counted.pairs, counted.discount, models), ANSWER)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_featured(at, counted.shards, len(models), then, arrow), schema)


N_FEATURES = 6


def features(d: np.ndarray, block: tc.Block) -> np.ndarray:
    """Of each document, from its letters' differences: difference of length-normalised log-likelihoods; the same over
    the strongest word, the next, and the third; and the text's length in two forms. All zero for a text without letters."""
    n = len(block)
    out = np.zeros((n, N_FEATURES))
    if not len(block.data):
        return out
    d = d.astype(np.float64)
    size = np.diff(block.at)
    total = np.concatenate([[0], np.cumsum(d)])
    sums = total[block.at[1:]] - total[block.at[:-1]]
    w = tc.words(block, keep=_FOLD != 0x20)
    if not len(w.start):
        return out
    end = np.minimum(w.end + 1, block.at[1:][w.doc])  # with the blank after the word
    value = (total[end] - total[w.start]) / np.sqrt(end - w.start)
    order = np.lexsort((-value, w.doc))
    rank = np.arange(len(order)) - w.first[w.doc[order]]
    for k in range(3):
        pick = order[rank == k]
        out[w.doc[pick], 1 + k] = np.clip(value[pick], -4, 12)
    some = np.diff(w.first) > 0
    out[some, 0] = np.clip(20 * sums[some] / size[some], -8, 8)
    out[some, 4] = np.log1p(size[some])
    out[some, 5] = np.clip(sums[some] / np.sqrt(size[some]), -12, 12)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression on standardised features and their squares."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _design((x - mean) / spread)
    a = np.zeros(z.shape[1])
    ridge = np.full(len(a), 1.0)
    ridge[0] = 1e-6
    for _ in range(100):
        p = sigmoid(z @ a)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * a)
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return a, mean, spread


def _design(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.column_stack([np.ones(len(z)), z, z[:, [1, 4]] ** 2, z[:, 1] * z[:, 4]])


@dataclass
class Scorer:
    """Counts and calibration; without counts every text has the same score."""

    counted: Counted | None
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scores(self) -> Callable:
        """Scores of texts by their features."""
        weights, mean, spread = self.weights, self.mean, self.spread
        # sums differ in their last digits with a text's place in its block
        return lambda x: np.round(sigmoid(_design((x - mean) / spread) @ weights), 9)

    def flat(self) -> float:
        return float(self.scores()(np.zeros((1, N_FEATURES)))[0])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, use=None) -> Scorer:
    """Fit models and calibration. labels: doc_id and toxic (0 or 1; of several labels the highest holds; null is none).

    ``use`` is a condition on labels.doc_id that says which labels may be learned from. Counts cover all texts and
    all such labels; calibration takes at most CALIBRATION of the labelled documents that have a text, of each class
    half as many or what the other leaves, and then corrects for the classes' true numbers. Unless labels of both
    kinds have texts, the score is the share of toxic labels (0 if there are none).
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = (known if use is None else known.where(use)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))
    known = known.withColumn("fold", (2 * half + F.when(F.col("toxic"), 0).otherwise(1)).cast("int"))
    n = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("bigint")), F.lit(0)).alias("t")).first()
    folds = known.select("doc_id", "fold")
    folds = F.broadcast(folds) if n["n"] <= MOST_SENT else folds
    has = durable(_texts(docs).where(F.octet_length("text") > 0).join(folds, "doc_id").select("doc_id", "fold").distinct())
    kinds = {r["kind"]: r["count"] for r in has.groupBy((F.col("fold") % 2).alias("kind")).count().collect()}
    if len(kinds) < 2:
        share = n["t"] / n["n"] if n["n"] else 0.0
        weights = np.zeros(_design(np.zeros((1, N_FEATURES))).shape[1])
        weights[0] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Scorer(None, weights, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    joined = _texts(docs).join(folds, "doc_id", "left").select("text", F.coalesce("fold", F.lit(4)).alias("fold"))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = min(max(SHARDS[0], -(-size // SHARD_TEXT)), SHARDS[1])
    parts = joined.mapInArrow(freeing(_count(shards)), "shard int, keys binary, counts binary")
    counted = durable(parts.groupBy("shard").applyInArrow(_gathered, COUNTED), shards, 1)
    told = counted.select("pairs", "often").collect()  # 65,536 letter pairs, of which a shard has some
    pairs = _shared_pairs(told)
    often = sum(np.frombuffer(r["often"], np.int64).reshape(ORDER + 1, 2 * len(_MODELS), _OFTEN + 1) for r in told)
    one, two = often[:, :, 1], often[:, :, 2]
    discount = np.where((one > 0) & (two > 0), one / np.maximum(one + 2 * two, 1), DISCOUNT)
    everything = Counted(counted, pairs, discount, shards)
    # each half's documents are scored by the model of the other half
    most = {k: max(CALIBRATION // 2, CALIBRATION - kinds[1 - k]) for k in kinds}
    pick, other = (has.where(F.col("fold") % 2 == k).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most[k]) for k in (0, 1))
    sample = _texts(docs).join(F.broadcast(pick.unionByName(other)), "doc_id").select("text", "fold")
    names = ["fold", *(f"f{i}" for i in range(N_FEATURES))]

    def other_half(batch: pa.RecordBatch, x: list[np.ndarray]) -> pa.RecordBatch:
        x = np.where((batch.column(1).to_numpy() >= 2)[:, None], x[0], x[1])
        return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i]) for i in range(N_FEATURES))], names=names)

    sample = _scanned(sample, everything, (0, 1), other_half, f"fold int, {', '.join(f'{x} double' for x in names[1:])}")
    got = np.array([tuple(r) for r in sample.collect()], float).reshape(-1, 1 + N_FEATURES)
    drop(has)
    weights, mean, spread = _logistic(got[:, 1:], (got[:, 0] % 2 == 0).astype(float))
    # a class drawn more thinly than the other has odds that are too low by that factor
    plain, toxic = (kinds[k] / min(kinds[k], most[k]) for k in (1, 0))
    weights[0] += np.log(toxic / plain)
    return Scorer(everything, weights, mean, spread)


def _gathered(table: pa.Table) -> pa.Table:
    try:
        return _gather(table)
    finally:
        release()


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score (0 to 1) of every row; texts alone decide. Null texts count as empty, and empty ones get the
    score of a text without letters. Rows are independent, and other columns are not read."""
    ship(docs.sparkSession)
    docs = _texts(docs)
    if scorer.counted is None:
        return docs.select("doc_id", F.lit(scorer.flat()).alias("score"))
    schema, scores = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]), scorer.scores()
    return _scanned(docs, scorer.counted, (2,), lambda batch, x: pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(x[0]))], schema=schema), "doc_id bigint, score double", schema)


def drop_toxic(docs: DataFrame, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """docs, with all its columns, without the rows whose text scores ``least`` or more. Null and empty texts have the score
    of a text without letters; equal texts go or stay alike, whatever their doc_id. An empty table stays one."""
    ship(docs.sparkSession)
    if scorer.counted is None:
        return docs.where(F.lit(scorer.flat() < least))
    scores = scorer.scores()
    return _scanned(docs, scorer.counted, (2,), lambda batch, x: batch.filter(pa.array(scores(x[0]) < least)), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's score by models of the labels outside the held-out fifth."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fifth = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))  # a null doc_id is held out
    done = score(docs, fit(docs, labels, use=fifth != 0))
    return done.select("doc_id", (fifth == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
