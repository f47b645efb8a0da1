"""Pauses as state: a paused customer is held until a return comes or the grace passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "customer_id {key}, subscription_id {sub}, mrr decimal(18,2), period_end date, status string, next_start date, gap_days int"
_DAY = 86_400_000


def events_of(subscriptions: DataFrame) -> DataFrame:
    """What happens to customers, as it becomes known: a start on the day a period starts, and a pause on the day a
    paused period ends. at is the event's time; customers without an id have no timeline and are left out."""
    at = lambda day: F.col(day).cast("timestamp")
    start = F.struct(F.lit("start").alias("kind"), at("period_start").alias("at"))
    pause = F.struct(F.lit("pause").alias("kind"), at("period_end").alias("at"))
    both = F.when(F.col("status") == "paused", F.array(start, pause)).otherwise(F.array(start))
    rows = subscriptions.where("customer_id is not null").select("customer_id", "subscription_id", "mrr", F.explode(both).alias("e"))
    return rows.select("customer_id", "subscription_id", "mrr", "e.kind", "e.at").where("at is not null")


class Pauses(StatefulProcessor):
    """One customer. Starts and open pauses are kept in two maps by time; a timer at the end of each pause's grace tells it is churn.

    Rows may come late and in any order within the watermark, so a start answers a pause only when the watermark has
    reached it: then no earlier start can come any more. Starts before every open pause and the watermark are let go.
    """

    def __init__(self, grace_days: int) -> None:
        self.grace = grace_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getMapState("starts", "at bigint", "n int")
        self.open = handle.getMapState("open", "at bigint, subscription_id string, n bigint", "mrr decimal(18,2)")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for kind, at, sub, mrr in zip(batch["kind"], batch["at"], batch["subscription_id"], batch["mrr"]):
                ms = int(at.timestamp() * 1000)
                if kind == "start":
                    self.starts.updateValue((ms,), (1,))
                    self.handle.registerTimer(ms)
                else:
                    n = 0
                    while self.open.containsKey((ms, str(sub), n)):  # repeated rows are pauses of their own
                        n += 1
                    self.open.updateValue((ms, str(sub), n), (mrr,))
                    self.handle.registerTimer(ms + self.grace)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        starts = sorted(k[0] for k in self.starts.keys())
        left, out = [], []
        for (end, sub, n), (mrr,) in sorted(self.open.iterator()):
            # all that starts up to now is known
            start = next((s for s in starts if end < s <= now), None)
            if start is not None and start - end <= self.grace:
                out.append((key[0], sub, mrr, end, "paused_returned", start))
            elif now >= end + self.grace:
                out.append((key[0], sub, mrr, end, "churned", None))
            else:
                left.append(end)
                continue
            self.open.removeKey((end, sub, n))
        oldest = min(left, default=now)
        for s in starts:
            if s <= oldest and s <= now:
                self.starts.removeKey((s,))
        if out:
            day = lambda ms: None if ms is None else pd.Timestamp(ms, unit="ms").date()
            yield pd.DataFrame([(c, int(s), m, day(e), status, day(b), None if b is None else (b - e) // _DAY) for c, s, m, e, status, b in out], columns=["customer_id", "subscription_id", "mrr", "period_end", "status", "next_start", "gap_days"]).astype({"gap_days": "Int32"})

    def close(self) -> None:
        pass


def resolve_pauses(events: DataFrame, grace_days: int, lateness: str = "30 days") -> DataFrame:
    """A row for each pause when its fate is known: paused_returned with the next start, or churned when the grace has passed.

    events: events_of() a stream. A pause at the stream's end whose grace has not passed is still open. The session's state store has to be RocksDB
    (PROVIDER), as timers need it. A late start (beyond the watermark) is dropped, like any late row.
    """
    ship(events.sparkSession)
    kinds = dict(events.dtypes)
    schema = OUTPUT.format(key=kinds["customer_id"], sub="bigint")
    held = events.withWatermark("at", lateness)
    return held.groupBy("customer_id").transformWithStateInPandas(Pauses(grace_days), schema, "append", "EventTime")
