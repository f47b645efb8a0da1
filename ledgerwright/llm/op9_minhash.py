"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

Two collections of ``half_keys`` short keys are computed per document, each key from ``rows``
minhashes. A table key is a pair of one key from either collection, so half_keys squared tables
cost only 2 * half_keys * rows minhashes. Two sets of similarity s meet in some table unless one
collection has no common key: at the default 14 keys of 3 rows a pair at exactly 0.8 is missed
with probability 2 * (1 - 0.8**3)**14, below 1e-4.

The product is never written out: documents are grouped by keys of the first collection, and only
groups of two or more documents are extended by the second.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .components import components
from .session import drop, durable, freeing, ship

WORDS = 5
HALF_KEYS = 14
ROWS = 3
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 2**64, 4096, dtype=np.uint64)
_MUL = _rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)


def half_key_values(h: np.ndarray, at: np.ndarray, half_keys: int, rows: int) -> np.ndarray:
    """Keys of both collections, int64 [sets, 2 * half_keys], of the sets h[at[i]:at[i+1]]; none may be empty."""
    out = np.empty((len(at) - 1, 2 * half_keys), np.uint64)
    for k in range(2 * half_keys):
        key = np.full(len(at) - 1, k + 1, np.uint64)
        for r in range(rows):
            i = k * rows + r
            key = tc.mix(key + np.minimum.reduceat((h ^ _XOR[i]) * _MUL[i], at[:-1]))
        out[:, k] = key
    return out.view(np.int64)


def set_digest(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify each nonempty set."""
    one = np.add.reduceat(tc.mix(h ^ _XOR[4000]), at[:-1])
    two = np.add.reduceat(tc.mix(h ^ _XOR[4001]), at[:-1])
    return tc.mix(one).view(np.int64), tc.mix(two).view(np.int64)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])


def _features(words: int, half_keys: int, rows: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for b in tc.blocks(texts):
                h, at = tc.shingle_sets(tc.words(b), len(b), words)
                n = np.diff(at)
                some = np.flatnonzero(n > 0)
                cut = np.append(at[some], len(h))
                a, z = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                keys = np.empty((0, 2 * half_keys), np.int64)
                if len(some):
                    a[some], z[some] = set_digest(h, cut)
                    keys = half_key_values(h, cut, half_keys, rows)
                per = np.zeros(len(n) + 1, np.int32)
                per[1:] = np.cumsum((n > 0) * half_keys)
                lists = [pa.ListArray.from_arrays(pa.array(per), pa.array(np.ascontiguousarray(x).ravel())) for x in (keys[:, :half_keys], keys[:, half_keys:])]
                yield pa.RecordBatch.from_arrays([ids.slice(b.lo, len(b)), pa.array(n), pa.array(a), pa.array(z), *lists], schema=_FEATURES)

    return run


def _sets(words: int):
    """The documents' shingle sets as sorted 64-bit hashes."""
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for b in tc.blocks(texts):
                h, at = tc.shingle_sets(tc.words(b), len(b), words)
                ends = (at * 8).astype(np.int32)
                items = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(b.lo, len(b)), items], schema=schema)

    return run


#: Counters for the rarity of shingles, one byte each on a logarithmic scale, so that none is ever full. The table is
#: bounded, as any order that is the same for all sets is exact; counters that several shingles share only let more
#: pairs through to the confirmation.
COUNTERS = 1 << 24
_CHUNKS = 64
_SCALE = 8  # steps for each doubling: 2**31 occurrences are 248


def _place(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def _count(batches):
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
    total = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for items in batch.column("items"):
            total[_place(np.frombuffer(items.as_buffer(), np.uint64))] += 1
    pack = zstandard.ZstdCompressor(level=1)
    for k, x in enumerate(total.reshape(_CHUNKS, -1)):
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack.compress(x.tobytes())], pa.binary())], schema=schema)


def _add_counts(table: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor()
    total = np.zeros(COUNTERS // _CHUNKS, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(unpack.decompress(x.as_buffer()), np.uint32)
    level = np.minimum(np.ceil(_SCALE * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
    return pa.table([table.column("chunk").slice(0, 1), pa.array([level.tobytes()], pa.binary())], names=["chunk", "counts"])


def _rarity(sets: DataFrame):
    """How often shingles occur, as a logarithm, by counter: COUNTERS bytes whatever the corpus, for every executor."""
    spark = sets.sparkSession
    rows = sets.mapInArrow(freeing(_count), "chunk int, counts binary").groupBy("chunk").applyInArrow(lambda table: _add_counts(table), "chunk int, counts binary").collect()
    counts = np.zeros((_CHUNKS, COUNTERS // _CHUNKS), np.uint8)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return spark.sparkContext.broadcast(counts.ravel())


_PREFIX = "bucket bigint, node bigint, part bigint, n_shingles bigint, pos bigint, was bigint"


def _prefixes(num: int, den: int, rarity, level: int):
    """Rows by the shingles that may come next in a set after ``level`` shingles in common, the rarest first.

    Of two sets similar enough, whatever the order, the smallest common shingle is among the first
    ``size - least common + 1`` of either, and the next one after it among one more. At level 0 a bucket is a
    shingle; further on, a bucket and the next shingle after its place in the set. was: rows of the bucket before.
    """
    names = [f.split()[0] for f in _PREFIX.split(", ")]

    def run(batches):
        count = rarity.value
        for batch in batches:
            nodes, parts = batch.column("node").to_numpy(), batch.column("part").to_numpy()
            buckets = batch.column("bucket").to_numpy().view(np.uint64) if level else None
            places = batch.column("pos").to_numpy() if level else np.full(len(nodes), -1)
            was = batch.column("was").to_numpy() if level else np.full(len(nodes), 2**62)
            keys, row, pos, sizes = [], [], [], []

            def rows():
                own = np.repeat(np.array(row), [len(k) for k in keys])
                columns = [np.concatenate(keys).view(np.int64), nodes[own], parts[own], np.repeat(np.array(sizes, np.int64), [len(k) for k in keys]), np.concatenate(pos), was[own]]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

            held = 0
            for i, items in enumerate(batch.column("items")):
                h = np.frombuffer(items.as_buffer(), np.uint64)
                n = len(h)
                end = n - -(-num * n // den) + 1 + level
                first = int(places[i]) + 1
                if first >= end:
                    continue
                some = h[np.lexsort((h, count[_place(h)]))[first:end]]
                keys.append(tc.mix(some + tc.mix(buckets[i : i + 1])) if level else some)
                row.append(i), sizes.append(n), pos.append(np.arange(first, first + len(some)))
                held += len(some)
                if held > 1 << 18:
                    yield rows()
                    keys, row, pos, sizes, held = [], [], [], [], 0
            if keys:
                yield rows()

    return run


def _confirm(num: int, den: int):
    """Of pairs with both sets, those with den * intersection >= num * union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column("items_a"), batch.column("items_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if not len(x):
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=schema)

    return run


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (80, 100), words: int = WORDS, half_keys: int = HALF_KEYS, rows: int = ROWS) -> DataFrame:
    """Class of each document under links of similarity at least ``similarity`` (a fraction) of their shingle sets.

    A document's set holds its distinct runs of ``words`` words (lower-cased A-Z, cut at ASCII blanks);
    with fewer words, the whole sequence; without any it is empty and linked with nothing. Returns
    doc_id, n_shingles and component_id, the smallest doc_id reachable over links, one row for each row
    of docs. Rows that share a doc_id count as one document. Rows with a null doc_id stay apart, with a
    null component_id. Null texts count as empty. Other columns are not read.

    Equal sets form one class first. Each member of a table's bucket is then confirmed against the
    bucket's smallest member, one pair a member, and what that joins becomes a component. What is left
    are members of one bucket in different components. Among these an exact rule finds every pair that
    can still be linked: two sets that similar share one of the rarest shingles of each (a share of
    1 - similarity of the set, and one more), whatever order rarity is taken in. Crowded shingles are refined by
    the next one that a pair would share, and the next. So neither a large group of near copies nor a passage
    that many documents share costs all pairs of its members, and there is no cap on members or pairs.
    """
    num, den = similarity
    if not (half_keys > 0 < rows and 2 * half_keys * rows <= 4000):
        raise ValueError("half_keys * rows has to be between 1 and 2000")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = durable(docs.mapInArrow(freeing(_features(words, half_keys, rows)), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, left array<bigint>, right array<bigint>"))

    usable = features.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("left").alias("left"), F.any_value("right").alias("right"))
    classes = durable(classes, features.count(), 20_000)

    # the first collection's buckets with two classes or more, extended by the second collection
    firsts = classes.select("node", "n_shingles", "right", F.explode("left").alias("key"))
    crowded = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    seconds = firsts.join(crowded, "key").select("node", "n_shingles", F.explode("right").alias("second"), "key")
    tables = seconds.select("node", "n_shingles", F.xxhash64("key", "second").alias("bucket"))
    heads = tables.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "head")
    members = durable(tables.join(heads, "bucket").select("bucket", "node", "n_shingles", "head"))

    size = lambda x, y: F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y)  # noqa: E731  else the sizes alone rule it out
    star = members.where((F.col("node") != F.col("head.node")) & size(F.col("n_shingles"), F.col("head.n_shingles")))
    star = star.select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    taking_part = members.select("node").distinct()
    sets = durable(
        docs.join(taking_part.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(freeing(_sets(words)), "node bigint, items binary").distinct()
    )
    n_members = members.count()
    linked = durable(_confirmed(star, sets, num, den), n_members)

    whole = components(linked, linked.count())
    placed = members.select("bucket", "node", "n_shingles").join(whole.withColumnRenamed("v", "node"), "node", "left")
    placed = placed.select("bucket", "node", "n_shingles", F.coalesce("component", "node").alias("part"))
    split = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
    apart = placed.join(split, "bucket", "left_semi").select("node", "part").distinct()
    shelved = durable(sets.join(apart, "node"))
    rarity = _rarity(shelved)
    rest = _shared(shelved, rarity, num, den)
    rarity.destroy()
    pairs = reduce(DataFrame.unionByName, rest, star.limit(0)).distinct().join(star, ["a", "b"], "left_anti")
    later = durable(_confirmed(pairs, sets, num, den), sum(x.count() for x in rest), 20_000)
    drop(members, sets, linked, shelved, *rest)
    up = whole.select(F.col("v"), "component")
    named = later.join(up.withColumnRenamed("v", "a").withColumnRenamed("component", "ca"), "a", "left").join(up.withColumnRenamed("v", "b").withColumnRenamed("component", "cb"), "b", "left")
    merged = components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), later.count())
    drop(later)

    label = classes.select("set_a", "set_b", "node", "n_shingles").join(whole.withColumnRenamed("v", "node"), "node", "left")
    label = label.select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("v"))
    label = label.join(merged.withColumnRenamed("component", "final"), "v", "left").select("set_a", "set_b", "n_shingles", F.coalesce("final", "v").alias("found"))
    out = features.select("doc_id", "n_shingles", "set_a", "set_b").join(label, ["set_a", "set_b", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))


#: A bucket with more rows is dealt to tasks in pieces of this size; it is one of _SHARE at most, as each has more than
#: that share of all rows, and these are sent to every executor.
_BUCKET = 256
_SHARE = 20_000
#: Shingles by which a bucket is refined at most, and pairs that may come from one without that, for each row it would take.
_DEEPEST = 4
_PAIRS_A_ROW = 8.0


def _shared(shelved: DataFrame, rarity, num: int, den: int) -> list[DataFrame]:
    """Tables of pairs (a, b) of nodes of different parts, among them all that are similar enough.

    Rows of a bucket's largest part meet only those of others, so a large group never meets itself. A pair is in
    the bucket of its common shingles in order, so refining a bucket by the next shingle loses none.
    """
    level, found = 0, []
    rows = durable(shelved.mapInArrow(freeing(_prefixes(num, den, rarity, 0)), _PREFIX))
    while rows is not None:
        # the smaller set of a pair shares one of an even shorter prefix
        short = (num + den) * (level + F.col("n_shingles") - F.col("pos")) >= 2 * num * F.col("n_shingles")
        need = F.floor((num * F.col("n_shingles") + den - 1) / den)
        # rows that refining would give, and pairs that it would spare: of like sizes, and one of them with a short prefix
        ahead = F.greatest(level + F.col("n_shingles") - need - F.col("pos"), F.lit(0))
        kind = F.floor(F.log("n_shingles") / np.log(den / num))
        # hash aggregates all the way: a crowded bucket comes as partial sums
        grouped = rows.groupBy("bucket", "part", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short"), F.sum(ahead).alias("ahead"), F.min("was").alias("was"))
        by_kind = grouped.groupBy("bucket", "kind").agg(F.sum("n").alias("n"), F.sum("short").alias("short"), F.sum("ahead").alias("ahead"), F.max("n").alias("most"), F.min("part").alias("p"), F.max("part").alias("q"), F.min("was").alias("was"))
        sizes = by_kind.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("short") * (F.col("n") - F.when(F.col("p") == F.col("q"), F.col("n")).otherwise(F.col("most")))).alias("pairs"), F.sum("ahead").alias("ahead"), F.min("p").alias("p"), F.max("q").alias("q"), F.sum("short").alias("short"), F.max("most").alias("most"), F.min("was").alias("was"))
        # a large component or copies that share shingle after shingle would only come again in every refined bucket
        apart = (4 * F.col("most") <= F.col("n")) & (2 * F.col("n") <= F.col("was"))
        sizes = durable(sizes.where("p <> q and short > 0").select("bucket", "n", "pairs", "ahead", (apart & (F.col("pairs") > _PAIRS_A_ROW * F.col("ahead"))).alias("crowded")), rows.count() // 2, 200_000)
        most = max(_BUCKET, (sizes.agg(F.sum("n")).first()[0] or 0) // _SHARE)
        is_hot = F.col("n") > most  # of at most _SHARE buckets
        refined = F.col("crowded") & F.lit(level < _DEEPEST)
        kinds = (~is_hot & ~refined, is_hot & ~refined, ~is_hot & refined, is_hot & refined)
        pairs, ahead = (F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)) for c, x in ((~refined, "pairs"), (refined, "ahead")))
        *counts, pairs, ahead = sizes.agg(*map(F.count_if, kinds), pairs, ahead).first()
        calm = rows.join(F.broadcast(sizes.where(is_hot).select("bucket")), "bucket", "left_anti") if counts[1] or counts[3] else rows
        if counts[0]:
            found.append(durable(_met(calm.join(sizes.where(~is_hot & ~refined).select("bucket"), "bucket", "left_semi"), None, level, num, den), pairs, 200_000))
        if counts[1]:
            wide = sizes.where(is_hot & ~refined).select("bucket", F.ceil(F.col("n") / most).cast("int").alias("pieces"))
            found.append(durable(_met(rows.join(F.broadcast(wide.select("bucket")), "bucket", "left_semi"), wide, level, num, den), pairs, 200_000))
        again = []
        if counts[2]:
            again.append(calm.join(sizes.where(~is_hot & refined).select("bucket", F.col("n").alias("before")), "bucket"))
        if counts[3]:
            again.append(rows.join(F.broadcast(sizes.where(is_hot & refined).select("bucket", F.col("n").alias("before"))), "bucket"))
        level, now, rows = level + 1, rows, None
        if again:
            deeper = reduce(DataFrame.unionByName, again).select("bucket", "node", "pos", F.col("before").alias("was")).join(shelved, "node")
            rows = durable(deeper.mapInArrow(freeing(_prefixes(num, den, rarity, level)), _PREFIX), ahead, 20_000)
        drop(now, sizes)
    return found


def _met(rows: DataFrame, wide: DataFrame | None, level: int, num: int, den: int) -> DataFrame:
    """Pairs of rows that share a bucket and may be similar enough by size and place. ``wide``: the buckets, a bounded
    number, and into how many pieces their rows are dealt; those outside the largest part go to each."""
    by_part = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = by_part.groupBy("bucket").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    if wide is None:
        loose, other = rows.join(largest, "bucket").withColumn("piece", F.lit(0)), rows.withColumn("piece", F.lit(0))
    else:
        largest = F.broadcast(largest.join(F.broadcast(wide), "bucket"))
        loose = rows.join(largest, "bucket").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        other = rows.join(F.broadcast(wide), "bucket").withColumn("piece", F.pmod(F.hash("node"), F.col("pieces")))
    loose = loose.where("part <> largest").select("bucket", "piece", "part", "node", "n_shingles", "pos")
    other = other.select("bucket", "piece", F.col("part").alias("other"), F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("pos").alias("pos_b"))
    n, pos, n_b, pos_b = (F.col(c) for c in ("n_shingles", "pos", "n_b", "pos_b"))
    # what follows the shared shingles in either set bounds the intersection
    enough = (num + den) * (level + F.least(n - pos, n_b - pos_b)) >= num * (n + n_b)
    size = den * F.least(n, n_b) >= num * F.greatest(n, n_b)
    met = loose.join(other, (loose["bucket"] == other["bucket"]) & (loose["piece"] == other["piece"]) & (F.col("part") != F.col("other")) & size & enough)
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    return both.mapInArrow(freeing(_confirm(num, den)), "a bigint, b bigint").distinct()


def keep_first(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest of their class; rows with a null doc_id stay.

    Of several rows with the kept doc_id all stay.
    """
    found = near_duplicates(docs, **parameters).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["__gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: four-word shingles, similarity 0.8."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), (80, 100), words=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
