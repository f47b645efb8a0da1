"""Cleaning of raw exports. Each operator gives what it keeps, what it takes out, and a line for the audit."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.money import needs_parsing, parse_amount, total
from ..functions.naming import own
from ..functions.running import first_rows

BUSINESS_KEY = ("customer_id", "subscription_id", "issued_date", "amount", "status")
AMOUNTS = ("amount", "base_amount", "addon_amount")
# Spellings of segments, and the name of what is absent.
SEGMENTS = {
    "smb": "SMB", "s.m.b.": "SMB",
    "mid-market": "Mid-Market", "midmarket": "Mid-Market", "mid market": "Mid-Market",
    "enterprise": "Enterprise", "ent": "Enterprise",
}
UNKNOWN = "Unknown"


@dataclass
class Step:
    """Result of an operator: rows that go on, rows taken out (or None), and its audit line."""

    kept: DataFrame
    removed: DataFrame | None
    audit: DataFrame


# What a step did, in words.
DETAILS = {
    "standardise spelling": "spellings of segments fewer than before",
    "label absent attributes": f"absent attributes labelled {UNKNOWN}",
    "parse amounts": "rows with an amount written as text",
    "remove duplicates": "rows after the first of their business key",
    "quarantine orphans": "rows of customers that are not known",
    "attribute refunds": "refunds booked under the day of what they reverse",
    "apply corrections": "rows replaced by corrections, and the change of revenue",
    "resolve pauses": "pauses that became churn",
    "flag time zone drift": "events booked under another day than their own",
}


def audit_line(df: DataFrame, step: str, ruling: str | None, table: str, rows: Column, dollars: Column) -> DataFrame:
    """One row; an aggregate that Spark computes with partial sums on each task."""
    return _line(df.agg(rows.alias("n"), dollars.alias("d")), step, ruling, table, F.col("n"), F.col("d"))


def _line(df: DataFrame, step: str, ruling: str | None, table: str, rows: Column, dollars: Column) -> DataFrame:
    return df.select(*_fields(step, ruling, table, rows, dollars))


def _fields(step: str, ruling: str | None, table: str, rows: Column, dollars: Column) -> list[Column]:
    return [
        F.lit(step).alias("step"), F.lit(ruling).cast("string").alias("ruling"), F.lit(table).alias("table"), F.coalesce(rows, F.lit(0)).cast("bigint").alias("rows_affected"),
        F.coalesce(dollars, F.lit(0)).cast("decimal(28,2)").alias("dollars"), F.lit(DETAILS[step]).alias("detail"),
    ]


def _lines(one: DataFrame, lines: list[tuple]) -> DataFrame:
    """Audit lines of a single row of sums."""
    return one.select(F.inline(F.array(*(F.struct(*_fields(*x)) for x in lines))))


def audit_table(steps: list[Step]) -> DataFrame:
    return reduce(DataFrame.unionByName, (s.audit for s in steps))


def parse_amounts(invoices: DataFrame, columns: tuple[str, ...] = AMOUNTS) -> Step:
    touched = reduce(Column.__or__, (needs_parsing(F.col(c)) for c in columns))
    kept = invoices.withColumns({c: parse_amount(F.col(c)) for c in columns})
    return Step(kept, None, audit_line(invoices, "parse amounts", None, "invoices", F.count_if(touched), F.lit(0)))


def remove_duplicates(invoices: DataFrame, order_by: list[Column], key: tuple[str, ...] = BUSINESS_KEY) -> Step:
    """First row of each business key, in an order that the caller states; amounts have to be parsed before.

    Both sides are mergeable aggregates: the first row is a minimum, the others are what is left of all rows when the
    first ones are taken away, as often as each occurs. The audit line is the difference of two sums."""
    kept = first_rows(invoices, key, order_by)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("amount").alias("d")]
    both = invoices.agg(*sums).crossJoin(F.broadcast(kept.agg(*(c.alias(f"first_{n}") for c, n in zip(sums, "nd")))))  # two single rows
    line = _line(both, "remove duplicates", None, "invoices", F.col("n") - F.col("first_n"), F.col("d") - F.col("first_d"))
    return Step(kept, invoices.exceptAll(kept), line)


def quarantine_orphans(invoices: DataFrame, customers: DataFrame, key: str = "customer_id") -> Step:
    known = customers.select(key).distinct()
    removed = invoices.join(known, key, "left_anti")
    return Step(invoices.join(known, key, "left_semi"), removed, audit_line(removed, "quarantine orphans", None, "invoices", F.count(F.lit(1)), F.sum("amount")))


def dispositions(invoices: DataFrame, customers: DataFrame, order_by: list[Column], name: str = "disposition", key: tuple[str, ...] = BUSINESS_KEY) -> DataFrame:
    """Each row with its fate: duplicate, orphan (of the first rows of their keys) or clean.

    Rows and first rows are counted together by content, so one of several equal rows is the first one."""
    rows, firsts, known = own(invoices, "__rows", "__firsts", "__known")
    mark = lambda df, a, b: df.withColumns({rows: F.lit(a), firsts: F.lit(b)})
    counted = mark(invoices, 1, 0).unionByName(mark(first_rows(invoices, key, order_by), 0, 1)).groupBy(*invoices.columns).agg(F.sum(rows).cast("int").alias(rows), F.sum(firsts).cast("int").alias(firsts))
    copies = F.concat(F.array_repeat(F.lit("first"), F.col(firsts)), F.array_repeat(F.lit("duplicate"), F.col(rows) - F.col(firsts)))
    told = counted.withColumn(name, F.explode(copies)).drop(rows, firsts)
    marked = told.join(customers.select("customer_id").distinct().withColumn(known, F.lit(True)), "customer_id", "left")
    return marked.withColumn(name, F.when(F.col(name) == "duplicate", "duplicate").when(F.col(known).isNull(), "orphan").otherwise("clean")).drop(known)


def invoice_audit(invoices: DataFrame, firsts: DataFrame, customers: DataFrame, columns: tuple[str, ...] = AMOUNTS) -> DataFrame:
    """The audit lines of amounts, duplicates and orphans from two aggregates: over raw rows (``columns`` as they were
    written, amount parsed) and over the first rows of their business keys."""
    touched = reduce(Column.__or__, (needs_parsing(F.col(c)) for c in columns))
    (known,) = own(firsts, "__known")
    fates = firsts.join(customers.select("customer_id").distinct().withColumn(known, F.lit(True)), "customer_id", "left")
    lost = F.col(known).isNull()
    raw = invoices.agg(F.count_if(touched).alias("n1"), F.count(F.lit(1)).alias("n0"), F.sum("amount").alias("d0"))
    own_sums = fates.agg(F.count(F.lit(1)).alias("n4"), F.sum("amount").alias("d4"), F.count_if(lost).alias("n3"), F.sum(F.when(lost, F.col("amount"))).alias("d3"))
    sums = raw.crossJoin(F.broadcast(own_sums))  # two single rows
    lines = [("parse amounts", F.col("n1"), F.lit(0)), ("remove duplicates", F.col("n0") - F.col("n4"), F.col("d0") - F.col("d4")), ("quarantine orphans", F.col("n3"), F.col("d3"))]
    return _lines(sums, [(step, None, "invoices", n, d) for step, n, d in lines])


def attribute_refunds(invoices: DataFrame, contract: Contract) -> Step:
    """effective_date: the date of the invoice that a refund reverses (the latest row of that id), else its own.

    Rows are made once and meet in one shuffle: each goes to its own id with its date, and a refund a second time to the
    id that it reverses, where it takes the latest date that came."""
    if contract.refunds_to_original_month:
        key, day, asks = own(invoices, "__key", "__day", "__asks")
        none, other = F.lit(None), F.col("reverses_invoice_id").cast("string")
        offer = lambda asking: F.struct(F.col("invoice_id").cast("string").alias(key), F.col("issued_date").alias(day), asking.alias(asks))
        ask = F.struct(other.alias(key), none.cast(invoices.schema["issued_date"].dataType).alias(day), F.lit(True).alias(asks))
        # a row that reverses nothing is there once, with asks unset; of a refund it is the second one that is kept
        sides = F.when(other.isNotNull(), F.array(offer(F.lit(False)), ask)).otherwise(F.array(offer(none.cast("boolean"))))
        # ids begin alike, so they are sorted by their hash first
        here = Window.partitionBy(F.xxhash64(key), key)
        met = invoices.select("*", F.inline(sides)).withColumn(day, F.max(day).over(here)).where(F.coalesce(F.col(asks), F.lit(True)))
        kept = met.withColumn("effective_date", F.when(F.col(asks), F.coalesce(day, "issued_date")).otherwise(F.col("issued_date"))).drop(key, day, asks)
    else:
        kept = invoices.withColumn("effective_date", F.col("issued_date"))
    moved = ~F.col("effective_date").eqNullSafe(F.col("issued_date"))
    back = kept.where("reverses_invoice_id is not null")  # other rows keep their date
    return Step(kept, None, audit_line(back, "attribute refunds", "R5", "invoices", F.count_if(moved), F.sum(F.when(moved, F.col("amount")))))


def apply_corrections(subscriptions: DataFrame, contract: Contract, key: tuple[str, ...] = ("customer_id", "period_start")) -> Step:
    """Corrections in place of the rows with their key; or, without restating, originals alone."""
    corrections, originals = subscriptions.where("is_correction"), subscriptions.where("not is_correction")
    if contract.restate_history:
        keys = corrections.select(*key).distinct()
        kept, removed = originals.join(keys, list(key), "left_anti").unionByName(corrections), originals.join(keys, list(key), "left_semi")
        change = corrections.agg(total("mrr").alias("c")).crossJoin(removed.agg(total("mrr").alias("r"), F.count(F.lit(1)).alias("n")))  # two single rows
        return Step(kept, removed, audit_line(change, "apply corrections", "R6", "subscriptions", F.max("n"), F.max(F.col("c") - F.col("r"))))
    return Step(originals, corrections, audit_line(corrections, "apply corrections", "R6", "subscriptions", F.count(F.lit(1)), F.lit(0)))


def next_start(subscriptions: DataFrame, width: int = 64) -> DataFrame:
    """next_start: the customer's first period that starts after a period's end.

    A customer's days are cut into ranges of ``width``, so one who has very many periods is dealt to as many tasks as
    there are ranges: within a range it is one sort by day, and from later ranges their first start is carried back, a
    row a customer and range. A period without an end has none.
    """
    day, start, row, block, later = own(subscriptions, "__day", "__start", "__row", "__block", "__later")
    starts = subscriptions.select("customer_id", F.unix_date("period_start").alias(day), F.col("period_start").alias(start)).distinct()
    # starts and ends in one sequence: the least start among the days after an end
    rows = subscriptions.withColumns({day: F.unix_date("period_end"), start: F.lit(None).cast("date"), row: F.lit(True)})
    both = rows.unionByName(starts.withColumn(row, F.lit(False)), allowMissingColumns=True).withColumn(block, F.floor(F.col(day) / width))
    ahead = Window.partitionBy("customer_id").orderBy(F.asc_nulls_last(block)).rowsBetween(1, Window.unboundedFollowing)
    firsts = both.where(F.col(block).isNotNull()).groupBy("customer_id", block).agg(F.min(start).alias(start)).select(F.col("customer_id").alias("__id"), F.col(block).alias("__b"), F.min(start).over(ahead).alias(later))
    within = Window.partitionBy("customer_id", block).orderBy(day).rangeBetween(1, Window.unboundedFollowing)
    local = both.withColumn(start, F.min(start).over(within)).where(F.col(row))
    found = local.join(firsts, F.col("customer_id").eqNullSafe(F.col("__id")) & (F.col(block) == F.col("__b")), "left")
    return found.withColumn("next_start", F.when(F.col(day).isNotNull(), F.coalesce(start, later))).drop(day, start, row, block, later, "__id", "__b")


def resolve_pauses(subscriptions: DataFrame, contract: Contract) -> Step:
    """paused rows become paused_returned or churned by the days until the customer's next period."""
    found = next_start(subscriptions).withColumn("gap_days", F.when(F.col("status") == "paused", F.datediff("next_start", "period_end")))
    status = F.when(F.col("status") == "paused", F.when(F.col("gap_days") <= contract.pause_grace_days, "paused_returned").otherwise("churned")).otherwise(F.col("status"))
    kept = found.withColumns({"was_paused": F.col("status") == "paused", "status": status})
    lost = F.col("was_paused") & (F.col("status") == "churned")
    return Step(kept, None, audit_line(kept, "resolve pauses", "R1", "subscriptions", F.count_if(lost), F.sum(F.when(lost, F.col("mrr")))))


def standardise_customers(customers: DataFrame, columns: tuple[str, ...] = ("segment", "industry", "region")) -> Step:
    trimmed = F.trim("segment")
    spelling = F.create_map(*(F.lit(x) for pair in SEGMENTS.items() for x in pair))
    segment = F.coalesce(F.try_element_at(spelling, F.lower(trimmed)), trimmed)
    kept = customers.withColumn("segment", segment).na.fill(UNKNOWN, list(columns))
    absent = reduce(Column.__add__, (F.col(c).isNull().cast("bigint") for c in columns))
    # spellings before, less those after; both lines from one aggregate
    sums = customers.agg((F.countDistinct("segment") - F.countDistinct(segment)).alias("n1"), F.sum(absent).alias("n2"))
    return Step(kept, None, _lines(sums, [("standardise spelling", None, "customers", F.col("n1"), F.lit(0)), ("label absent attributes", None, "customers", F.col("n2"), F.lit(0))]))


def flag_drift(usage: DataFrame) -> Step:
    """tz_drifted: the event's day differs from the day it is booked under."""
    kept = usage.withColumn("tz_drifted", ~F.to_date("event_ts").eqNullSafe(F.to_date("event_date")))
    return Step(kept, None, audit_line(kept, "flag time zone drift", None, "usage_events", F.count_if("tz_drifted"), F.lit(0)))


def clean(raw: dict[str, DataFrame], contract: Contract, order_by: list[Column]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All steps in the order that matters: amounts before duplicates, orphans among what is left, corrections
    before pauses. Returns the tables and the audit."""
    customers = standardise_customers(raw["customers"])
    amounts = parse_amounts(raw["invoices"])
    unique = remove_duplicates(amounts.kept, order_by)
    owned = quarantine_orphans(unique.kept, raw["customers"])
    dated = attribute_refunds(owned.kept, contract)
    restated = apply_corrections(raw["subscriptions"], contract)
    resolved = resolve_pauses(restated.kept, contract)
    usage = flag_drift(raw["usage_events"])
    tables = {
        "customers": customers.kept, "subscriptions": resolved.kept, "invoices": dated.kept, "usage_events": usage.kept,
        "quarantine_duplicate_invoices": unique.removed, "quarantine_orphan_invoices": owned.removed,
    }
    return tables, audit_table([customers, amounts, unique, owned, dated, restated, resolved, usage])


class Audit:
    """Audit lines that come with the writing of the tables: each figure is observed on the rows as they pass, so no
    table is read again to be counted. lines() may be called when every table has been written."""

    SCHEMA = "step string, ruling string, `table` string, rows_affected bigint, dollars decimal(28,2), detail string"

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}
        self.steps: list[tuple] = []

    def watch(self, df: DataFrame, name: str, **figures: Column) -> DataFrame:
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], *(c.alias(n) for n, c in figures.items()))

    def add(self, step: str, ruling: str | None, table: str, rows, dollars=lambda g: 0) -> None:
        """rows, dollars: from a look-up of (observation, figure)."""
        self.steps.append((step, ruling, table, rows, dollars))

    def lines(self, spark: SparkSession) -> DataFrame:
        got = {name: o.get for name, o in self.seen.items()}
        look = lambda name, figure: got[name][figure] or 0
        rows = [(step, ruling, table, int(n(look)), round(Decimal(d(look)), 2), DETAILS[step]) for step, ruling, table, n, d in self.steps]
        return spark.createDataFrame(rows, self.SCHEMA)


def watch_invoices(invoices: DataFrame, customers: DataFrame, order_by: list[Column], audit: Audit) -> DataFrame:
    """dispositions() of raw invoices, whose audit lines are observed as the rows are written."""
    touched = reduce(Column.__or__, (needs_parsing(F.col(c)) for c in AMOUNTS))
    (mark,) = own(invoices, "__touched")
    parsed = invoices.withColumn(mark, touched.cast("int")).withColumns({c: parse_amount(F.col(c)) for c in AMOUNTS})
    fates = dispositions(parsed, customers, order_by)
    fate = lambda f: F.col("disposition") == f
    fates = audit.watch(fates, "invoices", touched=F.sum(mark), **{f"n_{f}": F.count_if(fate(f)) for f in ("duplicate", "orphan")}, **{f"d_{f}": F.sum(F.when(fate(f), F.col("amount"))) for f in ("duplicate", "orphan")})
    audit.add("parse amounts", None, "invoices", lambda g: g("invoices", "touched"))
    for step, f in (("remove duplicates", "duplicate"), ("quarantine orphans", "orphan")):
        audit.add(step, None, "invoices", lambda g, f=f: g("invoices", f"n_{f}"), lambda g, f=f: g("invoices", f"d_{f}"))
    return fates.drop(mark)


def watch_refunds(clean_invoices: DataFrame, contract: Contract, audit: Audit) -> DataFrame:
    kept = attribute_refunds(clean_invoices, contract).kept
    moved = ~F.col("effective_date").eqNullSafe(F.col("issued_date"))
    audit.add("attribute refunds", "R5", "invoices", lambda g: g("refunds", "n"), lambda g: g("refunds", "d"))
    return audit.watch(kept, "refunds", n=F.count_if(moved), d=F.sum(F.when(moved, F.col("amount"))))


def watch_subscriptions(subscriptions: DataFrame, contract: Contract, audit: Audit) -> DataFrame:
    """Corrections and pauses in one write. What corrections replace is what was there and is no more."""
    amounts = {"n": F.count(F.lit(1)), "k": F.count_if("is_correction"), "d": F.sum("mrr"), "e": F.sum(F.when(F.col("is_correction"), F.col("mrr")))}
    restated = apply_corrections(audit.watch(subscriptions, "subscriptions_in", **amounts), contract).kept
    kept = resolve_pauses(restated, contract).kept
    lost = F.col("was_paused") & (F.col("status") == "churned")
    before = lambda g, c: g("subscriptions_in", c)
    if contract.restate_history:
        # originals that went; the change is what is there now, less the originals
        audit.add("apply corrections", "R6", "subscriptions", lambda g: before(g, "n") - g("subscriptions", "n"), lambda g: g("subscriptions", "d") - (before(g, "d") - before(g, "e")))
    else:
        audit.add("apply corrections", "R6", "subscriptions", lambda g: before(g, "k"))
    audit.add("resolve pauses", "R1", "subscriptions", lambda g: g("subscriptions", "lost"), lambda g: g("subscriptions", "gone"))
    return audit.watch(kept, "subscriptions", n=F.count(F.lit(1)), d=F.sum("mrr"), lost=F.count_if(lost), gone=F.sum(F.when(lost, F.col("mrr"))))


def watch_usage(usage: DataFrame, audit: Audit) -> DataFrame:
    audit.add("flag time zone drift", None, "usage_events", lambda g: g("usage", "n"))
    return audit.watch(flag_drift(usage).kept, "usage", n=F.count_if("tz_drifted"))


def watch_customers(customers: DataFrame, audit: Audit, columns: tuple[str, ...] = ("segment", "industry", "region")) -> DataFrame:
    """Spellings are observed as sets, before and after: the column has a handful of different values."""
    absent = reduce(Column.__add__, (F.col(c).isNull().cast("bigint") for c in columns))
    (before,) = own(customers, "__before")
    kept = standardise_customers(customers.withColumns({before: F.col("segment"), f"{before}_absent": absent})).kept
    seen = audit.watch(kept, "customers", absent=F.sum(f"{before}_absent"), was=F.size(F.collect_set(before)), now=F.size(F.collect_set(F.when(F.col(before).isNotNull(), F.col("segment")))))
    audit.add("standardise spelling", None, "customers", lambda g: g("customers", "was") - g("customers", "now"))
    audit.add("label absent attributes", None, "customers", lambda g: g("customers", "absent"))
    return seen.drop(before, f"{before}_absent")
