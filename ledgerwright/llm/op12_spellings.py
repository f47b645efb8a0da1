"""Spelling variants: words at edit distance one by a self-join of the vocabulary's trie.

The trie is cut at nodes with few words below them. Above the cut, a node at distance one of another has used up the
edit, so what follows in both words must be equal: the edit at each of the top positions is an equality join on the
word without that character, whose groups are no larger than the alphabet. Below the cut, a task holds one subtrie
and carries sets of active nodes down it, level by level: pairs of nodes at distance one, of like depth (a replaced
character) or of neighbouring depths (a deleted one). Pairs that end in two words are emitted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .session import drop, durable, freeing, ship

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word stands for another one that has at least so many times its occurrences.
DOMINANCE = 10
#: Runs whose checksum this number divides lose a character.
SLIP = 31
#: Words below a node that one task joins, and the depth at which cutting begins.
SUBTRIE, FIRST_CUT = 16_384, 2
#: Bytes of words that are counted together before they go to Spark.
_COUNTED = 8 << 20
#: Nodes of more words than this are looked up by a join without a broadcast.
_MOST_SENT = 100_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_TWO = 0xC3  # the first byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()
_LONG = 64


def checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:start+length], carried on from the checksum ``before`` of what precedes it."""
    state = ~before.astype(np.uint32)
    live = np.flatnonzero(length <= _LONG)
    for j in range(_LONG):
        live = live[length[live] > j]
        if not len(live):
            break
        own = state[live]
        state[live] = _CRC[(own ^ data[start[live] + j]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = ~state
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]], int(before[i]))
    return out


def _runs(block: tc.Block, ids: list[int | None], least: int, slip: int) -> pa.Array:
    """Runs of letters of at least ``least`` characters after their slips, with repeats."""
    data, at = block.data, block.at
    n = len(data)
    lead = data == _TWO
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    start_of = np.zeros(n + 1, bool)
    start_of[at[:-1][at[:-1] < n]] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before[:n] | start_of[:n]))
    end = np.flatnonzero(inside & (~after | start_of[1:])) + 1
    size = np.cumsum(np.concatenate([[0], inside & ((data & 0xC0) != 0x80)]))
    size = size[end] - size[start]
    long = np.flatnonzero(size >= least)
    start, end, size = start[long], end[long], size[long]
    low = tc.LOWER[data]
    doc = np.searchsorted(at, start, side="right") - 1
    known = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = checksums(low, start, end - start, known[doc])
    slips = h % slip == 0
    # words that stay as they are: their bytes, one after another
    a, z = start[~slips], end[~slips]
    mark = np.zeros(n + 1, np.int8)
    np.add.at(mark, a, 1)
    np.add.at(mark, z, -1)
    kept = low[np.cumsum(mark[:n], dtype=np.int8).view(bool)] if n else low
    offsets = np.concatenate([[0], np.cumsum(z - a)]).astype(np.int32)
    plain = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
    changed = []
    for i in np.flatnonzero(slips & (size > least)).tolist():
        word = low[start[i] : end[i]].tobytes().decode()
        k = int(h[i]) % len(word)
        changed.append((word[:k] + word[k + 1 :]).encode())
    return pa.concat_arrays([plain, pa.array(changed, pa.binary())])


def _counted(least: int, slip: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def told(parts: list[pa.Array]) -> pa.RecordBatch:
        counts = pc.value_counts(pa.concat_arrays(parts))
        return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for b in tc.blocks(batch.column("text")):
                parts.append(_runs(b, ids[b.lo : b.hi], least, slip))
                held += parts[-1].nbytes
                if held > _COUNTED:
                    yield told(parts)
                    parts, held = [], 0
        if parts:
            yield told(parts)

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word and n: runs of letters in lower case, after their slips, and how often they occur in all texts."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = docs.mapInArrow(freeing(_counted(least_length, slip)), "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _sorted_nodes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of sorted words side by side, where each begins, and their lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w in words], np.int64)
    return points, np.cumsum(size) - size, size


_POINTS = 1 << 21


def _below(of: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of nodes: which of ``of`` each belongs to, and the child."""
    n = count[of]
    which = np.repeat(np.arange(len(of)), n)
    return which, first[of][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of different words with one inserted, deleted or replaced character, each once.

    words: sorted by code point, all different. Level d has the trie's nodes at depth d, in order. ``same`` holds the
    active pairs of different nodes at this depth, ``less`` those of a node with one a level higher that lacks one
    of its characters. A child of an active node stays active by the same character below the other one; siblings
    and a child with its parent become active. No node at distance one is carried on by any further edit.
    """
    none = np.empty(0, np.int64)
    if len(words) < 2:
        return none, none
    points, at, size = _sorted_nodes(words)
    word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
    ends = np.array([0 if size[0] == 0 else -1])  # the word that ends at each node of this level
    upper_key, upper_end = none, ends  # children of the level above, that is, nodes of this one
    same, less = (none, none), (none, none)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n_nodes, depth = 1, 0
    while len(word):
        goes = size[word] > depth
        word, node = word[goes], node[goes]
        if not len(word):
            break
        char = points[at[word] + depth]
        key = node * _POINTS + char
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        child_key = key[fresh]
        parent, last = child_key // _POINTS, child_key % _POINTS
        child = np.cumsum(fresh) - 1
        child_end = np.where(size[word[fresh]] == depth + 1, word[fresh], -1)
        count = np.bincount(parent, minlength=n_nodes)
        first = np.cumsum(count) - count

        def partner(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.searchsorted(keys, wanted)
            place[place == len(keys)] = 0
            there = np.flatnonzero(keys[place] == wanted) if len(keys) else none
            return there, place[there]

        # deleted: a node below this level's node, with what the shorter one has below it on this level
        which, c = _below(less[0], first, count)
        there, v = partner(upper_key, less[1][which] * _POINTS + last[c])
        u, apart = c[there], v != less[0][which[there]]
        everyone = np.arange(len(child_key))
        next_less = (np.concatenate([u[apart], everyone]), np.concatenate([v[apart], parent]))
        # replaced: both go on by the same character; or siblings, each with those after it
        which, c = _below(same[0], first, count)
        there, v = partner(child_key, same[1][which] * _POINTS + last[c])
        more = count[parent] - (everyone - first[parent]) - 1
        a = np.repeat(everyone, more)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
        next_same = (np.concatenate([c[there], a]), np.concatenate([v, b]))
        for (x, y), below in ((next_same, child_end), (next_less, ends)):
            i, j = child_end[x], below[y]
            both = (i >= 0) & (j >= 0)
            found.append((i[both], j[both]))
        upper_key, ends = child_key, child_end
        same, less, node, n_nodes, depth = next_same, next_less, child, len(child_key), depth + 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)


_NEAR = "word string, other string, other_n bigint"


def _subtrie(table: pa.Table) -> pa.Table:
    table = table.sort_by("word")
    words = table.column("word").to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)  # by code point, whatever Arrow's order is
    words = [words[i] for i in order]
    n = table.column("n").to_numpy()[order]
    a, b = near_pairs(words)
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    held = pa.array(words, pa.string())
    return pa.table([held.take(pa.array(one)), held.take(pa.array(two)), pa.array(n[two])], names=["word", "other", "other_n"])


def _cut(words: DataFrame, most: int) -> DataFrame:
    """words with depth: the trie is cut where at most ``most`` words are below a node (or one that ends there)."""
    open_, done, written = words.withColumn("depth", F.least(F.length("word"), F.lit(FIRST_CUT))), [], []
    node = F.expr("substring(word, 1, depth)")
    # the first character in which the words below a node part, or the end of the shortest
    parting = F.expr("cast(array_position(transform(sequence(1, least(length(a), length(z)) + 1), i -> i <= least(length(a), length(z)) and substring(a, i, 1) = substring(z, i, 1)), false) as int)")
    while True:
        groups = open_.groupBy(node.alias("node"), "depth").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("a"), F.max("word").alias("z")).where(F.col("words") > most)
        crowded = durable(groups.select("node", parting.alias("next")))
        written.append(crowded)
        n = crowded.count()
        if not n:
            cut = durable(reduce(DataFrame.unionByName, done, open_))
            drop(*written)
            return cut
        side = F.broadcast(crowded) if n <= _MOST_SENT else crowded
        both = durable(open_.join(side, node == F.col("node"), "left").select("word", "n", F.coalesce("next", "depth").alias("depth"), F.col("next").isNotNull().alias("again")))
        written.append(both)
        done.append(both.where("not again").drop("again"))
        open_ = both.where("again").drop("again")


def near_words(words: DataFrame, most: int = SUBTRIE) -> DataFrame:
    """word, other, other_n: both directions of every pair of words one edit apart. words: word (all different), n."""
    ship(words.sparkSession)
    cut = _cut(words, most)
    leaf = F.substring(F.col("word"), F.lit(1), F.col("depth"))
    below = cut.select(leaf.alias("leaf"), F.col("depth"), "word", "n").groupBy("leaf", "depth").applyInArrow(lambda table: _subtrie(table.select(["word", "n"])), _NEAR)
    # above the cut: the edit is the first character in which two words differ, and what follows is equal
    places = F.explode(F.sequence(F.lit(1), F.least("depth", F.length("word"))))
    top = cut.select("word", "n", places.alias("i"))
    word, i = F.col("word"), F.col("i")
    head, tail = F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length("word"))
    replaced = top.select(F.concat(head, F.lit("*"), tail).alias("key"), F.struct("word", "n").alias("w")).groupBy("key").agg(F.collect_list("w").alias("group")).where(F.size("group") > 1)
    replaced = replaced.select(F.explode("group").alias("a"), "group").select("a", F.explode("group").alias("b")).where("a.word <> b.word")
    replaced = replaced.select(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))
    # of equal characters in a row, the last one stands for the edit
    deleted = top.where(F.substring(word, i, F.lit(1)) != F.substring(word, i + 1, F.lit(1))).select(F.concat(head, tail).alias("word"), F.col("word").alias("longer"), F.col("n").alias("longer_n"))
    pairs = deleted.join(words, "word")
    way = lambda a, b, n: F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(n).alias("other_n"))
    deleted = pairs.select(F.inline(F.array(way("word", "longer", "longer_n"), way("longer", "word", "n"))))
    return below.unionByName(replaced).unionByName(deleted)


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of its chain of forms. Each step has ten times the occurrences, so chains are short;
    every round doubles the steps taken."""
    now, count = durable(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("moved"))), 1
    while count:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = durable(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop(now)
        now, count = after, after.where("moved").count()
    return now.select("word", "root")


def spellings(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dominance: int = DOMINANCE, slip: int = SLIP, most: int = SUBTRIE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) are lower-cased in A-Z; a run whose checksum with its doc_id is
    divided by ``slip`` lacks a character. Words have ``least_length`` characters and ``least_count`` occurrences. The
    form is the near word with most occurrences, the smallest of equals, if it has ``dominance`` times the word's
    (else null); the root ends the chain of forms. Null and empty texts have no words; a null doc_id is empty in the
    checksum; repeated rows count each. A table without words gives no rows. Other columns are not read.
    """
    words = durable(vocabulary(docs, least_length, least_count, slip))
    near = near_words(words, most)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("b"))
    found = words.join(best, "word", "left")
    strong = -F.col("b.m") >= F.lit(dominance) * F.col("n")
    found = durable(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("b.w")).alias("form"), F.when(strong, -F.col("b.m")).alias("form_n")))
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: spelling variants of the documents' words."""
    return spellings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in SQL: checksums by a table and a fold, near words by what is left when a character goes.
SQL = """
WITH RECURSIVE
bits AS (SELECT i, 0 AS k, CAST(i AS UBIGINT) AS x FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, w, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(x) // 2 + 1), lambda j: CAST(('0x' || substr(x, 2 * j - 1, 2)) AS UBIGINT))), lambda s, b: xor(s >> 8, t[CAST(xor(s & 255, b) AS BIGINT) + 1])), 4294967295::UBIGINT) AS h
  FROM (SELECT w, n, hex(encode(concat(doc_id, ':', w))) AS x FROM r WHERE length(w) >= 7), crc),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN w[:CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2:] ELSE w END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.rest UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.rest),
f AS MATERIALIZED (SELECT v.word, v.n, count(p.other) AS n_near, CASE WHEN max(p.n) >= 10 * v.n THEN max(p.n) END AS form_n, CASE WHEN max(p.n) >= 10 * v.n THEN min(p.other) FILTER (WHERE p.n = m.most) END AS form
  FROM v LEFT JOIN p USING (word) LEFT JOIN (SELECT word, max(n) AS most FROM p GROUP BY word) m USING (word) GROUP BY v.word, v.n),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, form, e.at AS root, f.n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN (SELECT c.word, c.at FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL) e USING (word)"""
