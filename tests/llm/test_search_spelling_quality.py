"""Ranked search, spelling variants and quality outliers against brute force; odd tables for each."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import op11_ranking, op12_spellings, op13_outliers, queries
from ledgerwright.llm import textcore as tc

from .test_operators import LONG, ODD, REAL, none, odd, real, table  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def same_as_sql(spark, name, tmp, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        df.toPandas().to_parquet(f"{tmp}/{t}.parquet") if t != "documents" else df.write.mode("overwrite").parquet(f"{tmp}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}'")
    cursor = c.execute(queries.ORACLES[name])
    header = [d[0] for d in cursor.description]
    mine = [tuple(r[h] for h in header) for r in queries.QUERIES[name](spark, str(tmp)).collect()]
    assert sorted(map(repr, mine)) == sorted(map(repr, cursor.fetchall()))
    return mine


# ranked search


def ranked(docs, items, top=10):
    words = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(map(bool, words)), sum(map(len, words))
    df = collections.Counter(w for ws in words for w in set(ws))
    by_item: dict = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in by_item.items():
        scores = []
        for (d, _), ws in zip(docs, words):
            tf = collections.Counter(ws)
            m = 10 + (90 * len(ws) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in terms if tf[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def test_ranking_by_brute_force(spark, odd, none, monkeypatch):
    rnd = random.Random(5)
    vocabulary = ["w%d" % int(rnd.paretovariate(0.7)) for _ in range(400)] + ["Éa", "ño", "x-y", "THE", "the"]
    docs = [(rnd.randrange(300), " ".join(rnd.choices(vocabulary, k=rnd.randrange(60)))) for _ in range(400)] + ODD
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 30)))) for k in range(40)] + [(3, "w1 w2 again"), (None, LONG), (50, ""), (51, None), (52, "nowhere")]
    schema = "item_id long, text string, doc_id string"
    frame = spark.createDataFrame([(i, t, "z") for i, t in items], schema)
    want = ranked(docs, items)
    for text, block in ((op11_ranking.SHARD_TEXT, op11_ranking.BLOCK_TERMS), (3000, 50)):  # many shards, many blocks
        monkeypatch.setattr(op11_ranking, "SHARD_TEXT", text)
        monkeypatch.setattr(op11_ranking, "BLOCK_TERMS", block)
        got = op11_ranking.rank(table(spark, docs), frame)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert op11_ranking.rank(none, frame).count() == 0
    assert op11_ranking.rank(odd, frame.limit(0)).count() == 0
    assert op11_ranking.rank(odd.where("doc_id = 2"), frame).count() == 0


def test_shards_are_built_alike():
    ids = list(range(20, 0, -1)) + [None]
    texts = ["b a a"] * 20 + ["a"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    (row,) = list(op11_ranking._build(iter([batch])))
    packed = op11_ranking._unpack(row.column("docs")[0], np.int64)
    assert packed[:20].tolist() == list(range(1, 21)) and packed[21:].tolist() == [1] * 20 + [0]
    assert sorted(op11_ranking._unpack(row.column("counts")[0], np.int64).tolist()) == [20, 21]
    assert sorted(op11_ranking._unpack(row.column("often")[0], np.uint32).tolist()) == [1] * 21 + [2] * 20


def test_wand_skips():
    rnd = random.Random(2)
    lists, exact = [], collections.Counter()
    for k in range(12):
        docs = sorted(rnd.sample(range(4000), 3000 // (k + 1)))
        impacts = [rnd.randrange(1, 20 * (k + 1) ** 2) for _ in docs]
        for d, x in zip(docs, impacts):
            exact[d] += x
        lists.append((max(impacts), docs, impacts))
    told: list[int] = []
    got = op11_ranking.wand(lists, 10, told)
    assert got == sorted(((s, -d) for d, s in exact.items()), reverse=True)[:10]
    assert told[0] < len(exact) / 2  # most documents are never scored


def test_ranking_columns(spark, tmp_path, real):
    items = spark.read.parquet(f"{REAL}/benchmark.parquet")
    assert len(same_as_sql(spark, "op11_ranked_search", tmp_path, documents=real, benchmark=items)) == 400


# spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def variants(docs, least=7):
    words: collections.Counter = collections.Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            words[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = collections.Counter({w: n for w, n in words.items() if len(w) >= least and n >= 2})
    out, form = {}, {}
    for w, n in words.items():
        about = [v for v in words if near(w, v)]
        best = min(about, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(about), words[best] if form[w] else None]
    rows = []
    for w, rest in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, *rest))
    return sorted(rows, key=repr)


def misspelt(rnd, alphabet, n):
    base = ["".join(rnd.choices(alphabet, k=rnd.randrange(7, 11))) for _ in range(n)] + ["aaaaaaab", "aaaaaaaab", "aaaaaaa", "prefixes", "prefixe"]
    words = []
    for w in base:
        words += [w] * rnd.choice((2, 25, 300))
        for _ in range(3):
            i, c = rnd.randrange(len(w) + 1), rnd.choice(alphabet)
            words += [rnd.choice((w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]))] * rnd.choice((1, 2, 30))
    rnd.shuffle(words)
    return words


def test_spellings_by_brute_force(spark, odd, none):
    rnd = random.Random(4)
    words = misspelt(rnd, "abÉß", 60) + misspelt(rnd, "abcdefghijklmnop", 60)
    docs = [(k, " ".join(words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)] + ODD + [(11, "z" * 3000), (12, "z" * 3000 + " " + "z" * 2999)]
    want = variants(docs)
    for most in (op12_spellings.SUBTRIE, 8, 1):  # one subtrie, many, and each word its own
        got = op12_spellings.spellings(table(spark, docs), most=most)
        assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()), key=repr) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms
    assert op12_spellings.spellings(none).count() == 0
    assert op12_spellings.spellings(odd.where("doc_id < 4")).count() == 0


def test_near_pairs_by_brute_force():
    rnd = random.Random(3)
    for alphabet in ("a", "ab", "abcé"):
        words = sorted({"".join(rnd.choices(alphabet, k=rnd.randrange(0, 7))) for _ in range(150)})
        a, b = op12_spellings.near_pairs(words)
        got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist()))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


def test_checksums():
    data = np.frombuffer(b"abc" + b"x" * 200 + b"", np.uint8)
    before = np.array([zlib.crc32(b"7:"), zlib.crc32(b":"), zlib.crc32(b"")], np.uint32)
    got = op12_spellings.checksums(data, np.array([0, 3, 1]), np.array([3, 200, 0]), before)
    assert got.tolist() == [zlib.crc32(b"7:abc"), zlib.crc32(b":" + b"x" * 200), 0]


def test_spelling_columns(spark, tmp_path, real):
    assert len(same_as_sql(spark, "op12_spelling_variants", tmp_path, documents=real)) > 1000


# quality outliers


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(grams)
    repeated = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    return [
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
        len(lines), len(re.findall("[A-ZÀ-Þ]", text)), len(re.findall(r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]", text)),
    ]


@pytest.mark.parametrize("size", (1 << 21, 200))
def test_counts_by_brute_force(real, size):
    import pyarrow as pa

    texts = [t for _, t in ODD] + ["\n", "a\n\na\n", "x\r\nx\r\n", "a b c d e a b c d e", "a a a a a a", "Ÿ É ß\n# $\n# $", " \n \n"] + [r[0] for r in real.select("text").limit(60).collect()]
    got = np.concatenate([op13_outliers.counts_of(b) for b in tc.blocks(pa.array(texts, pa.string()), size)])
    assert got.tolist() == [plain_counts(t) for t in texts]


def plain_estimate(x, near, share):
    """Mean and covariance of the rows that are near, with the least spreads added."""
    own = x[near]
    cov = op13_outliers.consistency(share) * np.cov(own.T, bias=True)
    cov[np.diag_indices(len(cov))] += (np.array(op13_outliers.FLOORS) * op13_outliers.UNIT) ** 2
    return own.mean(axis=0), cov


def far(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_estimates_by_plain_version(spark, real):
    """A concentration step of our own lowers no determinant by more than the gain, and distances are those of the estimate."""
    stats = op13_outliers.verdicts(real)
    texts = [r for r in real.select("doc_id", "text").collect()]
    x = {r["doc_id"]: op13_outliers.vectors(np.array([plain_counts(r["text"])]))[0] for r in texts}
    rows = [r for r in stats.collect() if not r["base_failed"]]
    assert {(r["distance"] is None) for r in rows} == {True}  # fewer texts than a cell takes
    held = op13_outliers.verdicts(real, least_cell=50).where("distance is not null").collect()
    by_cell = collections.defaultdict(list)
    for r in held:
        by_cell[r["lang"]].append(r)
    assert by_cell
    frame = spark.createDataFrame([("c", *map(int, x[r["doc_id"]])) for r in by_cell["en"]], "cell string, " + ", ".join(f"x{i} int" for i in range(6)))
    estimates, cells = op13_outliers.covariances(frame)
    (e,) = estimates.collect()
    own = np.array([x[r["doc_id"]] for r in by_cell["en"]], float)
    inverse = np.zeros((6, 6))
    for i, j in op13_outliers._PAIRS:
        inverse[i, j] = inverse[j, i] = e[f"p{i}{j}"]
    mean = np.array([e[f"m{i}"] for i in range(6)])
    d = far(own, mean, np.linalg.inv(inverse))
    order = np.argsort(d)[: math.ceil(0.75 * len(d))]
    # of many subsets, drawn or concentrated by a plain version, none has a lesser determinant
    rnd = np.random.default_rng(1)
    best = np.linalg.slogdet(plain_estimate(own, order, 0.75)[1])[1]
    for _ in range(30):
        near = rnd.choice(len(own), len(order), replace=False)
        for _ in range(20):
            near = np.argsort(far(own, *plain_estimate(own, near, 0.75)))[: len(order)]
        assert np.linalg.slogdet(plain_estimate(own, near, 0.75)[1])[1] > best - 0.05
    # and the estimate is that of the texts within the cutoff of the best subset
    near = far(own, *plain_estimate(own, order, 0.75)) <= op13_outliers.chi_squared_at(6, 0.975)
    mean2, cov2 = plain_estimate(own, near, 0.975)
    assert np.abs(mean - mean2).max() < 8 and np.abs(inverse @ cov2 - np.eye(6)).max() < 0.25


def test_outliers_go_and_clean_texts_stay(spark, odd, none):
    rnd = random.Random(8)
    words = ["lorem", "Ipsum", "dolor", "sit,", "amet.", "consectetur", "adipiscing", "elit;", "sed", "do"]
    rows = []
    for k in range(900):
        own = [w + str(rnd.randrange(10**4)) for w in rnd.choices(words, k=rnd.randrange(30, 300))]
        kind = "plain"
        if k % 30 == 0:
            own, kind = [w.upper() + "!!" for w in own], "loud"
        if k % 30 == 1:
            own, kind = [w + "###" for w in own], "marked"
        if k % 30 == 2:
            own, kind = own[:8], "short"
        if k % 30 == 3:
            own, kind = own[:12] * 9, "repeated"
        rows.append((k, " ".join(own), kind, rnd.choice(("en", None)), "hot" if k % 3 else f"s{k % 7}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, cell string, lang string, source string")
    got = {r["doc_id"]: r for r in op13_outliers.verdicts(docs).collect()}
    assert len(got) == 900
    for k, _, kind, *_ in rows:
        assert got[k]["kept"] == (kind == "plain"), (k, kind, got[k])
        assert got[k]["base_failed"] == (kind in ("short", "repeated"))
    assert op13_outliers.verdicts(none).count() == 0
    found = op13_outliers.verdicts(odd).collect()
    assert len(found) == len(ODD)
    assert {r["doc_id"]: r["kept"] for r in found if r["doc_id"] in (1, 2, 3, 6)} == {1: False, 2: False, 3: False, 6: True}


def test_outliers_of_the_corpus(spark, real):
    """Texts labelled good stay, and most of the others go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = op13_outliers.verdicts(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in found}
    assert kept[1] > 0.99 and kept[0] < 0.2
