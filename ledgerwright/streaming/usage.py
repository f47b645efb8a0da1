"""Usage as a stream: daily activity by customer, with late rows counted until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import own


def daily_usage(events: DataFrame, lateness: str = "12 hours", key: str = "customer_id", time: str = "event_ts") -> DataFrame:
    """Events a day and customer. Time without a zone is taken as UTC, as a watermark needs one."""
    (at,) = own(events, "__at")
    stamped = events.withColumn(at, F.col(time).cast("timestamp")).withWatermark(at, lateness)
    return stamped.groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(F.to_date("w.start").alias("day"), key, "events")


def drifted_share(events: DataFrame, lateness: str = "12 hours") -> DataFrame:
    """Share of events a day that are booked under another day than they happened on."""
    (at,) = own(events, "__at")
    stamped = events.withColumn(at, F.col("event_ts").cast("timestamp")).withWatermark(at, lateness)
    off = (F.to_date("event_ts") != F.to_date("event_date")).cast("int")
    return stamped.groupBy(F.window(at, "1 day").alias("w")).agg(F.avg(off).alias("drifted"), F.count(F.lit(1)).alias("events")).select(F.to_date("w.start").alias("day"), "drifted", "events")
