"""Restating history where corrections touch it, and nowhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.calendar import Grid, asof_expand
from ..functions.money import total_if
from .cleaning import apply_corrections
from .retention import build_panel

KEY = ("customer_id", "period_start")


def touched_months(subscriptions: DataFrame, grid: Grid, corrections: DataFrame | None = None) -> DataFrame:
    """month, replaced_mrr, corrected_mrr, customers: months in which a correction is live, or a period that it replaces.

    corrections: those that are new (by default all of the table). A correction may be shorter or longer than what it
    replaces, so both sides count.
    """
    new = subscriptions.where("is_correction") if corrections is None else corrections
    columns = ("customer_id", "mrr", "period_start", "period_end")
    replaced = subscriptions.where("not is_correction").join(new.select(*KEY).distinct(), list(KEY), "left_semi")
    both = replaced.select(*columns, F.lit(False).alias("__new")).unionByName(new.select(*columns, F.lit(True).alias("__new")))
    live = asof_expand(both, grid, "month")
    return live.groupBy("month").agg(total_if(~F.col("__new"), F.col("mrr")).alias("replaced_mrr"), total_if(F.col("__new"), F.col("mrr")).alias("corrected_mrr"), F.count_distinct("customer_id").alias("customers"))


def panel_of_months(subscriptions: DataFrame, grid: Grid, months: DataFrame) -> DataFrame:
    """The panel of some months alone: rows of others are dropped before anything is shuffled."""
    return build_panel(subscriptions, grid, months)


def restated_panel(subscriptions: DataFrame, grid: Grid, contract: Contract) -> DataFrame:
    """The panel after corrections from the one before them: months that none touches are taken over as they are."""
    months = touched_months(subscriptions, grid).select("month")
    before = build_panel(subscriptions.where("not is_correction"), grid)
    after = panel_of_months(apply_corrections(subscriptions, contract).kept, grid, months)
    if not contract.restate_history:
        return before
    return before.join(F.broadcast(months), "month", "left_anti").unionByName(after)  # at most the grid's months


def write_months(fresh: DataFrame, months: DataFrame, path: str) -> list:
    """Replace the given months of a table that is partitioned by month; files of other months are not touched.

    Spark's dynamic overwrite replaces the partitions that have rows now. A month that has none any more loses its
    partition. Returns the months that were replaced. Running it again gives the same table.
    """
    spark = fresh.sparkSession
    rows = fresh.join(F.broadcast(months.select("month").distinct()), "month", "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    wanted = sorted(r["month"] for r in months.select("month").distinct().collect())  # at most the calendar's months
    left = {r["month"] for r in fresh.join(F.broadcast(months.select("month").distinct()), "month", "left_semi").select("month").distinct().collect()}
    _remove(spark, path, [m for m in wanted if m not in left])
    return wanted


def _remove(spark: SparkSession, path: str, months: list) -> None:
    for m in months:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={m}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def restate(spark: SparkSession, path: str, subscriptions: DataFrame, corrections: DataFrame, grid: Grid, contract: Contract) -> list:
    """Apply new corrections to a saved panel (partitioned by month); subscriptions has all corrections up to now,
    the new ones among them. Returns the months that were rewritten, none if policy lets history stand."""
    if not contract.restate_history:
        return []
    months = touched_months(subscriptions, grid, corrections).select("month")
    return write_months(panel_of_months(apply_corrections(subscriptions, contract).kept, grid, months), months, path)
