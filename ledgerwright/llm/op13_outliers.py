"""Quality rules by robust multivariate outliers: minimum covariance determinant by language and source.

Each text gives a vector of transformed statistics. Of every language and source, the three quarters of texts to be
trusted are those whose covariance has the least determinant: concentration steps take the texts nearest by Mahalanobis distance, and estimate mean and covariance from these alone, until no determinant falls. A step is
one aggregate over the table of vectors, by cell and by class of distance, so a cell that holds a third of all texts
is summed up on all tasks. Vectors are whole numbers, so sums do not depend on the order of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .session import drop, durable, freeing, ship

LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, (20, 100)
SYMBOLS = b"#*$%&|<>"
#: Texts that a cell of its own takes; smaller ones are pooled by language, and what is left there in one pool.
LEAST_CELL = 200
#: Share of a cell's texts that the covariance is made of; share of normal vectors within the distance that is kept.
TRUSTED, WITHIN = 0.75, 0.999
#: A step counts if it lowers the logarithm of a determinant by so much.
GAIN = 1e-3
#: Units of the vectors, and the least spread of each statistic: what a stray mark or a repeated line may change.
UNIT = 1024
STATISTICS = ("word_length", "symbols", "capitals", "marks", "repeated_lines", "repeated_words")
FLOORS = (0.05, 0.06, 0.06, 0.06, 0.15, 0.10)
#: Words, characters and lines that a text is taken to have besides its own, so that short ones vary less.
_WORDS, _CHARS, _LINES, _MEAN = 20, 100, 4, 5.0
#: Classes of distance for each doubling; cells that are looked up by a join without a broadcast beyond this number.
_CLASSES, _MOST_SENT = 32, 20_000
_P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]

_SYMBOL, _MARK, _CAPITAL = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(SYMBOLS)] = True
_MARK[0x21:0x7F] = True
for _span in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _MARK[slice(*_span)] = False
_MARK &= ~_SYMBOL
_CAPITAL[0x41:0x5B] = True

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = ", ".join([*(f"{c} bigint" for c in _COUNTS), *(f"x{i} int" for i in range(_P))])


def _sum_by(doc: np.ndarray, n: int, weight=None) -> np.ndarray:
    return np.bincount(doc, weight, minlength=n).astype(np.int64)


def counts_of(block: tc.Block) -> np.ndarray:
    """By text: words, their characters, symbols, repeated lines, repeated words, lines, capitals and marks."""
    n, data, at = len(block), block.data, block.at
    w = tc.words(block, lower=False)
    n_words = np.diff(w.first)
    within = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    blank = tc.BLANK[data]
    chars = within(~blank & ((data & 0xC0) != 0x80))
    # U+00C0 to U+00DE
    capital = _CAPITAL[data]
    if len(data):
        capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    # lines that have a word, and those of them that came before
    newline = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([at[:-1], newline + 1]))
    doc = np.searchsorted(at, start, side="right") - 1
    # a line break at a text's end is followed by an empty line, which has no word
    inside = (start < len(data)) & (doc < n)
    start, doc = start[inside], doc[inside]
    stop = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, start)], at[doc + 1]) if len(start) else start
    filled = np.concatenate([[0], np.cumsum(~blank)])
    some = filled[stop] > filled[start]
    start, stop, doc = start[some], stop[some], doc[some]
    h = tc.span_hash(tc.prefix_sums(data), start, stop)
    order = np.lexsort((start, h, doc))
    again = np.zeros(len(order), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    # words in runs of five that are there more than once
    g, first = tc.ngrams(w, WINDOW)
    owner = w.doc[first] if len(first) else np.empty(0, np.int64)
    by = np.lexsort((g, owner))
    equal = (g[by][1:] == g[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    twice = np.zeros(len(g), bool)
    twice[by[1:][equal]] = twice[by[:-1][equal]] = True
    depth = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(depth, first[twice], 1)
    np.add.at(depth, first[twice] + WINDOW, -1)
    covered = np.cumsum(depth[:-1]) > 0
    return np.column_stack([
        n_words, chars, within(_SYMBOL[data]), _sum_by(doc[order][again], n), _sum_by(w.doc[covered], n), _sum_by(doc, n), within(capital), within(_MARK[data])
    ])


def vectors(counts: np.ndarray) -> np.ndarray:
    """Transformed statistics in UNITs: the logarithm of the mean word's length, and the angles of five shares."""
    n_words, chars, symbols, lines, words, n_lines, capitals, marks = counts.T.astype(float)
    angle = lambda a, b: np.arcsin(np.sqrt(np.minimum(a / b, 1)))
    x = [np.log((chars + _WORDS * _MEAN) / (n_words + _WORDS)), *(angle(a, chars + _CHARS) for a in (symbols, capitals, marks)), angle(lines, n_lines + _LINES), angle(words, n_words + 2 * _WORDS)]
    return np.rint(UNIT * np.column_stack(x)).astype(np.int32)


def _describe(batches):
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    for batch in batches:
        for b in tc.blocks(batch.column("text")):
            counts = counts_of(b)
            x = vectors(counts)
            columns = [*(pa.array(counts[:, i]) for i in range(len(_COUNTS))), *(pa.array(x[:, i]) for i in range(_P))]
            rest = [batch.column(c).slice(b.lo, len(b)) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*columns, *rest], names=[*names, "doc_id", "lang", "source"])


def chi_squared(p: int, x: float) -> float:
    """Distribution function of chi-squared with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi_squared_at(p: int, share: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_squared(p, mid) < share else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """By what the covariance of the nearest ``share`` of normal vectors is too small."""
    return share / chi_squared(_P + 2, chi_squared_at(_P, share))


def estimate(n: int, s: np.ndarray, q: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and the logarithm of its determinant, of n vectors with sums s and products q."""
    mean = s / n
    cov = factor * (q / n - np.outer(mean, mean))
    cov[np.diag_indices(_P)] = np.maximum(np.diag(cov), 0) + (np.array(FLOORS) * UNIT) ** 2
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


_ESTIMATE = ", ".join(["cell string", "start int", "n bigint", "spread double", *(f"m{i} double" for i in range(_P)), *(f"p{i}{j} double" for i, j in _PAIRS)])
_NAMES = [f.split()[0] for f in _ESTIMATE.split(", ")]


def _estimates(factor: float):
    """Estimates from sums, one row a cell and start."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                q = np.zeros((_P, _P))
                for i, j in _PAIRS:
                    q[i, j] = q[j, i] = r[f"q{i}{j}"]
                mean, inverse, spread = estimate(r["n"], np.array([r[f"s{i}"] for i in range(_P)], float), q, factor)
                out.append([r["cell"], r["start"], r["n"], spread, *mean.tolist(), *(float(inverse[i, j]) for i, j in _PAIRS)])
            if out:
                columns = list(zip(*out))
                kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * (len(_NAMES) - 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    return run


def _robust_start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges by cell; vectors have a bounded number of values, so exact percentiles stay small."""
    q = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75))").alias(f"q{i}") for i in range(_P)))
    var = lambda i: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / F.lit(1.349), 2.0) + F.lit((FLOORS[i] * UNIT) ** 2)
    return q.select("cell", F.lit(0).alias("start"), "n", F.lit(float("inf")).alias("spread"), *(F.col(f"q{i}")[1].cast("double").alias(f"m{i}") for i in range(_P)), *((1 / var(i) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in _PAIRS))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    x = lambda i: F.col(f"x{i}").cast("bigint")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(x(i)).alias(f"s{i}") for i in range(_P)), *(F.sum(x(i) * x(j)).alias(f"q{i}{j}") for i, j in _PAIRS))


def distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_P)]
    terms = [F.col(f"p{i}{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _with(rows: DataFrame, estimates: DataFrame, cells: int) -> DataFrame:
    """rows with their cell's estimates: 300 bytes a cell, sent to every executor unless there are very many."""
    return rows.join(F.broadcast(estimates) if cells <= _MOST_SENT else estimates, "cell")


def _concentrated(rows: DataFrame, estimates: DataFrame, cells: int) -> DataFrame:
    """Sums of each cell's nearest texts: whole classes of distance, until they hold the trusted share."""
    near = F.floor(_CLASSES * F.log2(distance() + F.lit(2.0**-10))).cast("int")
    by_class = _sums(_with(rows, estimates, cells).withColumn("class", near), "cell", "start", "class")
    w = Window.partitionBy("cell", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = by_class.withColumns({"before": before, "whole": F.sum("n").over(w)}).where(F.col("before") < F.ceil(F.col("whole") * TRUSTED))
    return held.groupBy("cell", "start").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(_P)), *(F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in _PAIRS))


def covariances(rows: DataFrame) -> tuple[DataFrame, int]:
    """The estimates of every cell of rows (cell, x0, x1, ...), and their number.

    Two starts, medians with quartile ranges and plain moments, are concentrated side by side; the one with the lesser
    determinant wins and is estimated once more from the texts that it does not find far.
    """
    whole = _sums(rows, "cell").withColumn("start", F.lit(1)).mapInArrow(freeing(_estimates(1.0)), _ESTIMATE)
    now = durable(_robust_start(rows).unionByName(whole.withColumn("spread", F.lit(float("inf")))).withColumn("moved", F.lit(True)))
    cells, moved = now.count() // 2, 1
    while moved:  # only cells that still gain take another step
        old = now.drop("moved")
        new = _concentrated(rows, now.where("moved").drop("moved"), cells).mapInArrow(freeing(_estimates(consistency(TRUSTED))), _ESTIMATE)
        both = old.alias("o").join(new.alias("n"), ["cell", "start"], "left")
        gains = F.coalesce(F.col("n.spread") < F.col("o.spread") - GAIN, F.lit(False))
        after = durable(both.select("cell", "start", *(F.when(gains, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in _NAMES[2:]), gains.alias("moved")))
        drop(now)
        now, moved = after, after.where("moved").count()
    best = now.groupBy("cell").agg(F.min(F.struct("spread", "start")).alias("b")).select("cell", F.col("b.start").alias("start"))
    best = durable(now.drop("moved").join(best, ["cell", "start"]))
    far = chi_squared_at(_P, 0.975)
    kept = _sums(_with(rows, best, cells).where(distance() <= far), "cell", "start")
    done = durable(kept.mapInArrow(freeing(_estimates(consistency(0.975))), _ESTIMATE))
    drop(now, best)
    return done, cells


def verdicts(docs: DataFrame, least_cell: int = LEAST_CELL, within: float = WITHIN) -> DataFrame:
    """doc_id, the five counts, base_failed, distance (squared) and kept of every row of docs (doc_id, text, lang, source).

    A text of fewer than ten words, or with more than a fifth of them in runs of five that it repeats, fails at once
    and has no part in the estimates; its distance is null. Others are kept unless their distance from their cell is
    beyond that which holds the share ``within`` of normal vectors. A language and source with fewer than ``least_cell`` such texts is pooled with the others of its language,
    and a language's pool that is still smaller with those of all languages; if even that is smaller, its texts are kept with a null
    distance. Null texts count as empty; null languages and sources are values of their own; rows that share a doc_id
    are texts of their own. Ties cannot arise: whole classes of distance are taken. Other columns are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    told = docs.mapInArrow(freeing(_describe), f"{_FEATURES}, doc_id bigint, lang string, source string")
    share, whole = MOST_REPEATED
    failed = (F.col("n_words") < LEAST_WORDS) | (whole * F.col("n_repeat_words") > share * F.col("n_words"))
    stats = durable(told.withColumn("base_failed", failed))
    good = stats.where("not base_failed")
    by_source = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    alone = F.col("n") >= least_cell
    pool = F.sum(F.when(~alone, F.col("n"))).over(Window.partitionBy("lang"))  # a row a source
    # fields that are null are left out, so a null language is not the word null
    cell = F.when(alone, F.to_json(F.struct("lang", "source"))).when(F.col("pool") >= least_cell, F.to_json(F.struct("lang"))).otherwise("rest")
    cells = durable(by_source.withColumn("pool", pool).select(F.col("lang").alias("l"), F.col("source").alias("s"), cell.alias("cell"), "n"))
    small = durable(cells.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") < least_cell).select("cell"))
    sent = F.broadcast(cells.select("l", "s", "cell")) if cells.count() <= _MOST_SENT else cells.select("l", "s", "cell")
    placed = stats.join(sent, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    rows = placed.where("not base_failed").join(F.broadcast(small), "cell", "left_anti")  # at most one cell
    estimates, n_cells = covariances(rows.select("cell", *(f"x{i}" for i in range(_P))))
    sent = F.broadcast(estimates) if n_cells <= _MOST_SENT else estimates
    found = placed.join(sent.drop("n", "start", "spread"), "cell", "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return found.select("doc_id", "lang", "source", *_COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi_squared_at(_P, within))).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: counts of every document, and whether it is kept."""
    found = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *_COUNTS, "base_failed", "kept")
