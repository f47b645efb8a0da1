"""Backdated refunds as a join of two streams: each refund meets the invoice that it reverses, whichever comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import own


def date_refunds(refunds: DataFrame, invoices: DataFrame, before: str = "400 days", after: str = "0 days", lateness: str = "7 days", day: str = "issued_date") -> DataFrame:
    """Refunds (rows with reverses_invoice_id) with original_date: the day of an invoice of that id, or null.

    The invoice is issued at most ``before`` ahead of the refund and at most ``after`` behind it, which bounds what is
    held as state; a refund that meets none is emitted with null when the watermark has passed that span. An id that
    several invoices have gives a row for each: settle() keeps the latest. Rows later than ``lateness`` are dropped.
    """
    at, then, named = own(refunds, "__at", "__then", "__original")
    left = refunds.where("reverses_invoice_id is not null").withColumn(at, F.col(day).cast("timestamp")).withWatermark(at, lateness)
    right = invoices.select(F.col("invoice_id").alias(named), F.col(day).cast("timestamp").alias(then), F.col(day).cast("date").alias("original_date")).withWatermark(then, lateness)
    near = F.expr(f"`{named}` = reverses_invoice_id and `{then}` >= `{at}` - interval {before} and `{then}` <= `{at}` + interval {after}")
    return left.join(right, near, "left_outer").drop(at, then, named)


def settle(dated: DataFrame, day: str = "issued_date", copy: str = "copy") -> DataFrame:
    """Refunds as a batch reads them from the stream's sink: effective_date is the latest original's day, else their own.

    ``copy`` tells rows apart that are equal in all else, such as their place in the source."""
    keys = [c for c in dated.columns if c != "original_date"]
    return dated.groupBy(*keys).agg(F.max("original_date").alias("original_date")).withColumn("effective_date", F.coalesce("original_date", day)).drop("original_date", copy)
