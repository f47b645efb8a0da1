"""Readout of a two-arm experiment: is it sound, and what did it do."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import ratio, total, total_if
from ..functions.running import first_rows
from ..functions.shipping import ship

ARMS = ("control", "treatment")


def first_assignment(assignments: DataFrame) -> DataFrame:
    return first_rows(assignments, ("customer_id",), [F.col("assigned_date"), F.col("variant")])


def check_srm(assignments: DataFrame) -> DataFrame:
    """Sample-ratio mismatch against an even split: counts and the chi-squared statistic, in one aggregate."""
    counts = first_assignment(assignments).agg(*(F.count_if(F.col("variant") == a).alias(a) for a in ARMS))
    half = (F.col("control") + F.col("treatment")) / 2.0
    return counts.withColumn("chi_squared", F.when(half > 0, (F.pow(F.col("control") - half, 2) + F.pow(F.col("treatment") - half, 2)) / half))


def srm_p_value(chi_squared: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(chi_squared / 2))


def contaminated(assignments: DataFrame) -> DataFrame:
    """Customers that were in more than one arm."""
    return assignments.groupBy("customer_id").agg(F.countDistinct("variant").alias("arms")).where("arms > 1").select("customer_id")


def check_contamination(assignments: DataFrame) -> DataFrame:
    by = assignments.groupBy("customer_id").agg(F.countDistinct("variant").alias("arms"))
    return by.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("arms") > 1).alias("contaminated")).withColumn("rate", ratio(F.col("contaminated"), F.col("customers")))


def check_balance(assignments: DataFrame, customers: DataFrame, by: str = "segment") -> DataFrame:
    """Share of each arm by attribute, and their difference."""
    arms = first_assignment(assignments).join(customers.select("customer_id", by), "customer_id")
    counts = arms.groupBy(by).agg(*(F.count_if(F.col("variant") == a).alias(a) for a in ARMS))
    whole = Window.partitionBy()  # a row an attribute value
    shares = counts.select(by, *(ratio(F.col(a), F.sum(a).over(whole)).alias(f"{a}_share") for a in ARMS))
    return shares.withColumn("difference", F.col("treatment_share") - F.col("control_share"))


def build_outcomes(assignments: DataFrame, panel: DataFrame, customers: DataFrame, before: str, after: str) -> DataFrame:
    """Each assignment with segment and revenue before and after (0 if none), of customers who paid before."""
    at = lambda month, name: panel.where(F.col("month") == F.lit(month).cast("date")).select("customer_id", F.col("mrr").alias(name))
    joined = assignments.join(customers.select("customer_id", "segment"), "customer_id").join(at(before, "pre"), "customer_id").join(at(after, "post"), "customer_id", "left")
    return joined.withColumn("post", F.coalesce("post", F.lit(0)).cast("decimal(28,2)")).where("pre > 0")


def naive_readout(outcomes: DataFrame) -> DataFrame:
    """By arm: customers, revenue kept and mean revenue before, first assignments only, contamination ignored."""
    return first_assignment(outcomes).groupBy("variant").agg(F.count(F.lit(1)).alias("customers"), ratio(total("post"), total("pre")).alias("retention"), ratio(total("pre"), F.count(F.lit(1))).alias("mean_before"))


def naive_lift(outcomes: DataFrame) -> DataFrame:
    """One row: what each arm kept, and the difference that a reader who checks nothing would report."""
    kept = naive_readout(outcomes).agg(*(F.max(F.when(F.col("variant") == a, F.col("retention"))).alias(a) for a in ARMS))
    return kept.withColumn("lift", F.col("treatment") - F.col("control"))


def by_segment(outcomes: DataFrame, exclude: DataFrame | None = None, least: int = 20) -> DataFrame:
    """Lift within each segment, of strata with enough customers in both arms."""
    rows = outcomes if exclude is None else outcomes.join(exclude, "customer_id", "left_anti")
    arm = lambda a: F.col("variant") == a
    sums = first_assignment(rows).groupBy("segment").agg(
        *(F.count_if(arm(a)).alias(f"{a}_customers") for a in ARMS), *(total_if(arm(a), F.col(c)).alias(f"{a}_{c}") for a in ARMS for c in ("pre", "post"))
    )
    kept = sums.where(F.least(*(F.col(f"{a}_customers") for a in ARMS)) >= least).where("control_pre > 0 and treatment_pre > 0")
    rates = kept.withColumns({f"{a}_retention": ratio(F.col(f"{a}_post"), F.col(f"{a}_pre")) for a in ARMS})
    return rates.select("segment", *(f"{a}_customers" for a in ARMS), *(f"{a}_retention" for a in ARMS), (F.col("treatment_retention") - F.col("control_retention")).alias("lift"), (F.col("control_pre") + F.col("treatment_pre")).cast("decimal(28,2)").alias("weight"))


def stratified_lift(outcomes: DataFrame, exclude: DataFrame | None = None, least: int = 20) -> DataFrame:
    """Lift of segments weighted by their revenue before; null without any stratum."""
    s = by_segment(outcomes, exclude, least)
    return s.agg(ratio(F.sum(F.col("lift") * F.col("weight").cast("double")), F.sum("weight")).alias("lift"), F.count(F.lit(1)).alias("strata"))


#: A prime. A customer and a replicate each have a number below it by md5; their product modulo it, as a share, is
#: uniform over customers for every replicate, and independent between any two replicates.
PRIME = 2**31 - 1
#: Poisson's distribution function at 0 to 11, mean 1.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12))


def multipliers(seed: int, replicates: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}:replicate:{r}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1 for r in range(replicates)]


def bootstrap(outcomes: DataFrame, exclude: DataFrame | None = None, replicates: int = 600, seed: int = 7, least: int = 20, level: float = 0.95) -> DataFrame:
    """Interval of the stratified lift by resampling customers with Poisson weights.

    A weight depends on seed, customer and replicate alone, so the result is the same however rows are dealt out, and
    in any other engine that has md5.
    Tasks add up weighted revenue by segment, arm and replicate; no row is copied for a replicate.
    """
    ship(outcomes.sparkSession)
    rows = outcomes if exclude is None else outcomes.join(exclude, "customer_id", "left_anti")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:customer:"), F.col("customer_id").cast("string"))), 1, 8), 16, 10).cast("bigint") % (PRIME - 1) + 1
    rows = first_assignment(rows).where("customer_id is not null").select(number.alias("key"), "segment", "variant", F.col("pre").cast("double").alias("pre"), F.col("post").cast("double").alias("post"))
    names = ["segment", "variant", "replicate", "n", "pre", "post"]

    def partial(batches):
        factors, steps = np.array(multipliers(seed, replicates), np.int64), np.array(POISSON)
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                key = part.column("key").to_numpy()
                w = np.searchsorted(steps, (key[:, None] * factors[None, :] % PRIME) / PRIME).astype(np.float64)
                values = np.column_stack([np.ones(len(key)), part.column("pre").to_numpy(), part.column("post").to_numpy()])
                group = list(zip(part.column("segment").to_pylist(), part.column("variant").to_pylist()))
                for g in set(group):
                    own = np.array([x == g for x in group])
                    sums[g] = sums.get(g, 0) + w[own].T @ values[own]
        for (segment, variant), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment] * replicates, pa.string()), pa.array([variant] * replicates, pa.string()), pa.array(range(replicates), pa.int32()), *(pa.array(s[:, k]) for k in range(3))], names=names)

    parts = rows.mapInArrow(partial, _PARTS)
    return _interval(parts, least, level)


_PARTS = "segment string, variant string, replicate int, n double, pre double, post double"


def _interval(parts: DataFrame, least: int, level: float) -> DataFrame:
    """The interval of the stratified lift over replicates, from weighted sums of rows by segment, arm and replicate."""
    arm = lambda a, c: F.coalesce(F.sum(F.when(F.col("variant") == a, F.col(c))), F.lit(0.0)).alias(f"{a[0]}_{c}")
    strata = parts.groupBy("replicate", "segment").agg(*(arm(a, c) for a in ARMS for c in ("n", "pre", "post"))).where((F.least("c_n", "t_n") >= least) & (F.col("c_pre") > 0) & (F.col("t_pre") > 0))
    weight = F.col("c_pre") + F.col("t_pre")
    lifts = strata.groupBy("replicate").agg((F.sum((F.col("t_post") / F.col("t_pre") - F.col("c_post") / F.col("c_pre")) * weight) / F.sum(weight)).alias("lift"))
    tail = (1 - level) / 2
    return lifts.agg(F.expr(f"percentile(lift, {tail})").alias("low"), F.expr(f"percentile(lift, {1 - tail})").alias("high"), F.count(F.lit(1)).alias("replicates")).withColumn("includes_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


#: Customers that a task resamples at once, and the most tasks that they are dealt to: each has a share of every
#: replicate's size, which is what the driver sends out (some ten megabytes at most for 600 of them).
BUCKET, MOST_BUCKETS = 50_000, 2048


def split_sizes(counts: list[int], seed: int, replicates: int) -> np.ndarray:
    """How many of each replicate's draws fall to each bucket: binomial splitting of n draws over n customers."""
    n = sum(counts)
    shares = np.array(counts, float) / max(n, 1)
    return np.stack([np.random.Generator(np.random.PCG64([seed, r])).multinomial(n, shares) for r in range(replicates)]).astype(np.int64)


def drawn(seed: int, replicate: int, bucket: int, size: int, draws: int) -> np.ndarray:
    """How often each of a bucket's customers, in the order of their ids, is drawn in a replicate."""
    rng = np.random.Generator(np.random.PCG64([seed, replicate, bucket + 1]))
    return np.bincount(rng.integers(0, size, draws), minlength=size)


def resampled(outcomes: DataFrame, exclude: DataFrame | None = None, replicates: int = 600, seed: int = 7, size: int = BUCKET) -> DataFrame:
    """Weighted sums by segment, arm and replicate of exact resampling with replacement: every replicate has just as many customers
    as there are, each drawn with the same chance.

    Customers are dealt to buckets by a hash of their id. Of a replicate's draws a bucket gets a binomial share, and
    deals it to its own customers; so tasks need nothing from each other, and no customer is copied. A repeated task
    draws alike. First assignments count, rows without a customer_id do not.
    """
    ship(outcomes.sparkSession)
    rows = outcomes if exclude is None else outcomes.join(exclude, "customer_id", "left_anti")
    rows = first_assignment(rows).where("customer_id is not null").select(F.col("customer_id").cast("string").alias("who"), "segment", "variant", F.col("pre").cast("double").alias("pre"), F.col("post").cast("double").alias("post"))
    n = rows.count()
    buckets = min(MOST_BUCKETS, max(1, -(-n // size)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("who"), F.lit(buckets)).cast("int"))
    counts = [0] * buckets
    for r in dealt.groupBy("bucket").count().collect():  # at most MOST_BUCKETS rows
        counts[r["bucket"]] = r["count"]
    shares = rows.sparkSession.sparkContext.broadcast(split_sizes(counts, seed, replicates))

    def draw(key, table):
        bucket = key[0].as_py()
        table = table.take(pa.array(np.argsort(np.array(table.column("who").to_pylist(), object), kind="stable")))
        group = list(zip(table.column("segment").to_pylist(), table.column("variant").to_pylist()))
        groups = sorted(set(group), key=repr)
        own = np.array([groups.index(g) for g in group])
        pre, post = (table.column(c).to_numpy() for c in ("pre", "post"))
        sums = np.zeros((replicates, len(groups), 3))
        for r in range(replicates):
            w = drawn(seed, r, bucket, len(own), int(shares.value[r, bucket]))
            for k, v in enumerate((w, w * pre, w * post)):
                sums[r, :, k] = np.bincount(own, v, len(groups))
        flat = sums.reshape(-1, 3)
        segment, variant = ([g[i] for g in groups] * replicates for i in (0, 1))
        return pa.table([pa.array(segment, pa.string()), pa.array(variant, pa.string()), pa.array(np.repeat(np.arange(replicates), len(groups)).astype(np.int32)), *(pa.array(flat[:, k]) for k in range(3))], names=["segment", "variant", "replicate", "n", "pre", "post"])

    return dealt.groupBy("bucket").applyInArrow(draw, _PARTS)


def resampled_interval(outcomes: DataFrame, exclude: DataFrame | None = None, replicates: int = 600, seed: int = 7, least: int = 20, level: float = 0.95, size: int = BUCKET) -> DataFrame:
    """Interval of the stratified lift by exact resampling with replacement; see resampled()."""
    return _interval(resampled(outcomes, exclude, replicates, seed, size), least, level)


def verdict(chi_squared: float | None, rate: float | None, lift: float | None, low: float | None, high: float | None, alpha: float = 0.01) -> dict:
    """What the experiment can support: whether the split was as meant, whether an effect is apart from zero, and what to do."""
    p = srm_p_value(chi_squared or 0.0)
    sound = p >= alpha and not rate
    known = lift is not None and low is not None and high is not None
    apart = known and not low <= 0 <= high
    if not known:
        claim, advice = "no stratum has enough customers in both arms", "collect more customers before reading it out"
    elif not apart:
        claim, advice = f"no claim in either direction: the interval is {high - low:.1%} wide and spans zero", "mend the assignment and run it again; neither ship nor stop on these data"
    else:
        claim = f"the {'gain' if lift > 0 else 'loss'} is apart from zero after correction"
        advice = "act on it" if sound else "treat it as provisional: strata mend only the imbalance that was observed, so run it again with a verified split"
    return {"p_value": p, "split_as_meant": p >= alpha, "contaminated": bool(rate), "apart_from_zero": bool(apart), "claim": claim, "advice": advice}
