"""Language of every word by a linear-chain conditional random field, and of documents by its marginals.

A word's features are its prefixes and suffixes of one to three bytes, its three-byte strings, and itself
(the lexicon). Weights of features and of transitions between neighbouring words' languages are learned
together, on lines strung together from texts of different languages, so that switching within a text has
a learned price. Words are labelled by forward-backward over the whole text: chains are cut into pieces whose
transfer matrices are multiplied first, which gives exactly the marginals of the uncut chain.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .session import freeing, ship

#: Entries of the weight table, hashed; with one column a language.
TABLE = 1 << 18
AFFIX = 3
PIECE = 128
#: Pairs of words whose expected transitions are summed at once.
_EXPECT = 1 << 16
#: The model is fitted on at most this many texts of each language, of at most SAMPLE_BYTES bytes each.
SAMPLE_TEXTS = 300
SAMPLE_BYTES = 8192
UNKNOWN = "und"
_U = np.uint64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h ^ _U(salt * 0x9E3779B97F4A7C15 % 2**64)) * _U(0xC2B2AE3D27D4EB4F) >> _U(64 - 18)).astype(np.int32)


def word_features(block: tc.Block, w: tc.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table entries of each word's affixes and identity, [words, 7], those of the three-byte strings of all
    words one after another, and where each word's begin."""
    data = tc.LOWER[block.data]
    sums = tc.prefix_sums(data)
    columns = [_slot(w.hash, 1)]
    for k in range(1, AFFIX + 1):
        columns.append(_slot(tc.span_hash(sums, w.start, np.minimum(w.start + k, w.end)), 1 + k))
        columns.append(_slot(tc.span_hash(sums, np.maximum(w.end - k, w.start), w.end), 10 + k))
    x = np.concatenate([data, np.zeros(2, np.uint8)]).astype(_U)
    triple = x[:-2] | x[1:-1] << _U(8) | x[2:] << _U(16)
    count = np.maximum(w.end - w.start - 2, 1)  # a shorter word has one, with what follows it
    ends = np.cumsum(count)
    at = np.repeat(w.start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
    return np.stack(columns, axis=1) if len(w.start) else np.empty((0, 7), np.int32), _slot(triple[at], 20), ends - count


def emissions(weights: np.ndarray, own: np.ndarray, triples: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(own):
        return np.zeros((0, weights.shape[1]), np.float32)
    e = np.add.reduceat(weights[triples], first, axis=0)
    for k in range(own.shape[1]):
        e += weights[own[:, k]]
    return e


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(a.sum(axis=-1, keepdims=True), 1e-30)


def marginals(e: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginal of each word's label and, if wanted, the expected transitions, of chains first[i]:first[i+1] of e.

    start and trans are log-weights. Empty chains are allowed.
    """
    n, labels = e.shape
    if not n:
        return e.astype(np.float64), np.zeros((labels, labels)) if expect else None
    b = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float64)
    t = np.exp(trans - trans.max())
    size = np.diff(first)
    pieces = -(-size // PIECE)
    chain = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = first[:-1][chain] + nth * PIECE
    length = np.minimum(first[1:][chain] - lo, PIECE)
    order = np.argsort(-length, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    lo, length, chain, nth = lo[order], length[order], chain[order], nth[order]
    live = np.searchsorted(-length, -np.arange(1, int(length.max()) + 1), side="right")
    several = pieces[chain] > 1
    # transfer matrices of the pieces of cut chains
    enter = np.tile(_unit(np.exp(start - start.max())), (len(lo), 1))
    leave = np.ones((len(lo), labels))
    if several.any():
        own = np.flatnonzero(several)
        m = np.eye(labels)[None] * b[lo[own]][:, None, :]
        for k in range(1, len(live)):
            x = np.searchsorted(own, live[k])
            if not x:
                break
            m[:x] = (m[:x] @ t) * b[lo[own[:x]] + k][:, None, :]
            m[:x] /= m[:x].sum(axis=(1, 2), keepdims=True)
        at = np.full(len(lo), -1)
        at[own] = np.arange(len(own))
        cut = np.flatnonzero(pieces > 1)
        head = back[(np.cumsum(pieces) - pieces)[cut]]
        begin = (np.cumsum(pieces) - pieces)[cut]
        for k in range(1, int(pieces.max())):
            go = pieces[cut] > k
            here, before = back[begin[go] + k], back[begin[go] + k - 1]
            enter[here] = _unit(np.einsum("ni,nij->nj", enter[before], m[at[before]]) @ t)
        for k in range(int(pieces.max()) - 1, 0, -1):
            go = pieces[cut] > k
            here, before = back[begin[go] + k], back[begin[go] + k - 1]
            leave[before] = _unit(np.einsum("nij,nj->ni", m[at[here]], leave[here]) @ t.T)
        del head
    alpha, beta = np.empty_like(b), np.empty_like(b)
    now = _unit(enter * b[lo])
    alpha[lo] = now
    for k in range(1, len(live)):
        x = live[k]
        now = _unit((now[:x] @ t) * b[lo[:x] + k])
        alpha[lo[:x] + k] = now
    beta[lo + length - 1] = leave
    for k in range(len(live) - 2, -1, -1):
        x = live[k + 1]
        at = lo[:x] + k
        beta[at] = _unit((b[at + 1] * beta[at + 1]) @ t.T)
    if not expect:
        return _unit(alpha * beta), None
    inner = np.ones(n, bool)
    inner[first[:-1][size > 0]] = False
    expected = np.zeros((labels, labels))
    inside = np.flatnonzero(inner)
    for lo in range(0, len(inside), _EXPECT):
        i = inside[lo : lo + _EXPECT]
        pair = alpha[i - 1][:, :, None] * t[None] * (b[i] * beta[i])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return _unit(alpha * beta), expected


@dataclass
class Tagger:
    languages: list[str]
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray

    def words(self, block: tc.Block) -> tuple[tc.Words, np.ndarray]:
        w = tc.words(block, keep=_LETTER)
        own, triples, first = word_features(block, w)
        return w, marginals(emissions(self.weights, own, triples, first), w.first, self.start, self.trans)[0]

    def documents(self, block: tc.Block) -> tuple[list[str], np.ndarray]:
        """Each document's language and its share of the words, by their marginals."""
        n = len(block)
        share, names = np.zeros(n), [UNKNOWN] * n
        if not self.languages:
            return names, share
        w, p = self.words(block)
        some = np.flatnonzero(np.diff(w.first) > 0)
        if len(some):
            total = np.add.reduceat(p, w.first[some], axis=0)
            total /= total.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            ascii_ = np.concatenate([[0], np.cumsum(_ASCII_LETTER[block.data])])
            for i, k, v in zip(some.tolist(), best.tolist(), total.max(axis=1).tolist()):
                if ascii_[block.at[i + 1]] > ascii_[block.at[i]] or any(map(str.isalpha, block.bytes_of(i).decode("utf-8", "replace"))):
                    names[i], share[i] = self.languages[k], min(v, 1.0)
        return names, share


def train(samples: list[tuple[str, str]], seed: int = 1, epochs: int = 4, rate: float = 0.3, ridge: float = 1e-6) -> Tagger:
    """Fit on (text, language) pairs, whole lines of which are strung together at random."""
    languages = sorted({g for _, g in samples})
    rng = np.random.Generator(np.random.PCG64(seed))
    lines = [(line.encode("utf-8"), languages.index(g)) for text, g in samples for line in text.split("\n") if re.search(r"[^\W\d_]", line)]
    k = len(languages)
    weights, start, trans = np.zeros((TABLE, k), np.float32), np.zeros(k), np.zeros((k, k))
    if k < 2 or not lines:
        return Tagger(languages, weights, start, trans)
    order = rng.permutation(len(lines))
    # chains of one to four lines: most words follow one of their own language, some do not
    cuts = np.cumsum(rng.integers(1, 5, len(lines)))
    chains = np.split(order, cuts[cuts < len(lines)])
    batches, now, held = [], [], 0
    for c in chains:
        now.append(c)
        held += sum(len(lines[i][0]) for i in c)
        if held > 60_000:
            batches.append(now)
            now, held = [], 0
    if now:
        batches.append(now)
    prepared = []
    for batch in batches:
        texts = [b"\n".join(lines[i][0] for i in c) for c in batch]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        block = tc.Block(0, len(texts), np.frombuffer(b"".join(texts), np.uint8), at)
        w = tc.words(block, keep=_LETTER)
        marks = np.concatenate([np.cumsum([0] + [len(lines[i][0]) + 1 for i in c[:-1]]) + a for c, a in zip(batch, at[:-1])])
        label = np.array([lines[i][1] for c in batch for i in c])[np.searchsorted(marks, w.start, side="right") - 1]
        prepared.append((*word_features(block, w), w.first, label))
    speed, speed_t, speed_s = np.full((TABLE, k), 1e-2, np.float32), np.full((k, k), 1e-2), np.full(k, 1e-2)
    for _ in range(epochs):
        for own, triples, first, chain, label in (prepared[i] for i in rng.permutation(len(prepared))):
            if not len(label):
                continue
            p, expected = marginals(emissions(weights, own, triples, first), chain, start, trans, expect=True)
            wrong = p.copy()
            wrong[np.arange(len(label)), label] -= 1
            heads = chain[:-1][np.diff(chain) > 0]
            inner = np.ones(len(label), bool)
            inner[heads] = False
            i = np.flatnonzero(inner)
            seen = np.bincount(label[i - 1] * k + label[i], minlength=k * k).reshape(k, k)
            flat = np.concatenate([own.ravel(), triples])
            which = np.concatenate([np.repeat(np.arange(len(label)), own.shape[1]), np.repeat(np.arange(len(label)), np.diff(np.append(first, len(triples))))])
            touched, at = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(at, wrong[which, j], len(touched)) for j in range(k)], axis=1) / np.sqrt(len(label))
            grad += ridge * weights[touched]
            speed[touched] += grad**2
            weights[touched] -= rate * grad / np.sqrt(speed[touched])
            g = (expected - seen) / np.sqrt(len(label))
            speed_t += g**2
            trans -= rate * g / np.sqrt(speed_t)
            g = wrong[heads].sum(axis=0) / np.sqrt(len(label))
            speed_s += g**2
            start -= rate * g / np.sqrt(speed_s)
    return Tagger(languages, weights, start, trans)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, use=None) -> Tagger:
    """Learn from text and lang where lang is not null and ``use`` holds.

    The sample takes SAMPLE_TEXTS different texts of each language, or all it has, picked by a hash of their
    content; its size does not depend on the corpus. Texts of at most SAMPLE_BYTES bytes are taken whole and first,
    longer ones as their first SAMPLE_BYTES / 4 characters and only where a language has too few others. Every
    language there is gets learned; memory is in proportion to their number. Without any, every text is unknown.
    """
    ship(docs.sparkSession)
    fit_rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    fit_rows = (fit_rows if use is None else fit_rows.where(use)).select("text", F.col("lang").cast("string").alias("lang"))
    fits = F.octet_length("text") <= SAMPLE_BYTES
    draw = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20))
    # copies share a hash, so numbers of different hashes count texts without them
    keyed = fit_rows.select("lang", (~fits).cast("int").alias("long"), F.xxhash64("text", F.lit(17)).alias("h"))
    counts = keyed.groupBy("lang", "long").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    if not counts:
        return train([])
    # joined as a table of two rows a language
    shares = docs.sparkSession.createDataFrame([(r["lang"], r["long"], min(1 << 20, (2 * SAMPLE_TEXTS << 20) // r["n"] + 1)) for r in counts], "lang string, long int, share bigint")
    text = F.when(fits, F.col("text")).otherwise(F.substring("text", 1, SAMPLE_BYTES // 4))
    drawn = fit_rows.select("lang", (~fits).cast("int").alias("long"), draw.alias("draw"), text.alias("text")).join(F.broadcast(shares), ["lang", "long"]).where(F.col("draw") < F.col("share"))
    rows = sorted((r["lang"], r["long"], r["draw"], r["text"]) for r in drawn.groupBy("lang", "long", "text").agg(F.min("draw").alias("draw")).collect())
    taken: dict[str, int] = {}
    samples = []
    for lang, _, _, text in rows:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= SAMPLE_TEXTS:
            samples.append((text, lang))
    return train(samples)


def _predict(held):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for b in tc.blocks(batch.column("text")):
                names, share = held.value.documents(b)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.lo, len(b)), pa.array(names, pa.string()), pa.array(share)], schema=schema)

    return run


def predict(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, lang_pred and score of every row from its whole text alone. A null text or one without letters is
    ``und`` with score 0. Rows are independent; other columns are not read."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    return _texts(docs).mapInArrow(freeing(_predict(held)), "doc_id bigint, lang_pred string, score double")


RUNS = "array<struct<start:bigint,end:bigint,lang:string>>"


def label_words(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id and runs: maximal runs of words with one language as byte spans, in order; a row each, whatever its doc_id.
    Null and empty texts, and those without words, have no runs. Other columns are not read."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            for b in tc.blocks(batch.column("text")):
                rows: list[list[dict]] = [[] for _ in range(len(b))]
                if held.value.languages:
                    w, p = held.value.words(b)
                    best = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
                    fresh = np.append(True, (best[1:] != best[:-1]) | (w.doc[1:] != w.doc[:-1]))[: len(best)]
                    at = np.flatnonzero(fresh)
                    for i, j in zip(at.tolist(), np.append(at[1:], len(best)).tolist()):
                        d = w.doc[i]
                        rows[d].append({"start": int(w.start[i] - b.at[d]), "end": int(w.end[j - 1] - b.at[d]), "lang": held.value.languages[best[i]]})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.lo, len(b)), pa.array(rows, kind)], names=["doc_id", "runs"])

    return _texts(docs).mapInArrow(freeing(run), f"doc_id bigint, runs {RUNS}")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: languages of all documents, learned from two of three classes of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    third = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3))  # a null doc_id is learned from
    done = predict(docs, fit(docs, use=third != 1))
    return done.select("doc_id", (third == 1).alias("held_out"), "lang_pred", "score")
