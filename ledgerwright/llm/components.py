"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import drop, durable


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Smallest vertex reachable from each vertex that has an edge.

    edges: (a bigint, b bigint), undirected, repeats and loops allowed. Returns (v, component)
    for every vertex except those that are their component's smallest. Alternating large-star
    and small-star rounds; each hangs neighbours below the smallest one seen, so paths shrink
    geometrically and a hub is an aggregate and a join, never a group in memory. Each round is
    written to the shared folder. Rounds go on until one changes nothing. ``rows``: edges at most, where that is known.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = durable(edges.where("a <> b").select(high.alias("v"), low.alias("u")).distinct(), rows, 200_000)
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # large star: every larger neighbour of v hangs below the smallest neighbour
        large = now.select(F.col("u").alias("v"), F.col("v").alias("w")).join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        # small star: v and its smaller neighbours hang below the smallest of them
        floor = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(floor, "v").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("v"), F.col("e.m").alias("u")).where("v <> u").distinct()
        was, before = seen, now
        now = durable(small, 2 * seen[0], 200_000)
        drop(before)
        seen = _state(now)
        if was == seen:
            break
    return now.select("v", F.col("u").alias("component"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
