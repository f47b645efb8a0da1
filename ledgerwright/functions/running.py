"""Running totals of a series that no single task has to hold, and the first row of each key without a sort of the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .naming import own


def running_sums(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None, width: int = 256) -> DataFrame:
    """df with each of ``sums`` replaced by its total up to this place in ``order``, a whole number that is unique by key.

    Places are dealt to tasks in ranges of ``width``: totals of the ranges are added up first, a row a range, and
    each range then runs from its offset. So a long series takes as many tasks as it has ranges.
    """
    by = by or []
    block, *offsets = own(df, "__block", *(f"__before{i}" for i in range(len(sums))))
    blocks = df.withColumn(block, F.floor(F.col(order) / width))
    ahead = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*by, block).agg(*(F.sum(c).alias(o) for c, o in zip(sums, offsets)))
    keys = own(blocks, *(f"__k{i}" for i in range(len(by) + 1)))
    before = totals.select(*(F.col(c).alias(k) for c, k in zip([*by, block], keys)), *(F.sum(o).over(ahead).alias(o) for o in offsets))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*by, block], keys)))
    joined = blocks.join(before, same, "left")
    within = Window.partitionBy(*by, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kind = {f.name: f.dataType for f in df.schema.fields}
    total = lambda c, o: (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.coalesce(F.col(o), F.lit(0))).cast(kind[c]).alias(c)
    now = dict(zip(sums, offsets))
    return joined.select(*(total(c, now[c]) if c in now else F.col(c) for c in df.columns))


def first_rows(df: DataFrame, key: tuple[str, ...], order_by: list[Column]) -> DataFrame:
    """The first row of each key in an order (nulls first; the other columns decide between equals).

    A minimum over structs, so every task keeps a row a key and a key with half of all rows is no larger than another.
    """
    (name,) = own(df, "__first")
    places = [f"__o{i}" for i in range(len(order_by))]
    row = F.struct(*(c.alias(p) for c, p in zip(order_by, places)), F.struct(*df.columns).alias("row"))
    return df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key))).agg(F.min(row).alias(name)).select(f"{name}.row.*")
