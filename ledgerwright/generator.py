"""Made-up billing data with known defects, seeded, and the same however rows are dealt out.

Every draw is a hash of the seed, a stream's name and the row's keys, so tables need no order to be
reproducible. Customers' subscription histories are small state machines, one customer at a time. Three causes of
falling retention are planted: a price rise that heavy users of the smallest plan leave over, a competitor to whom
mid-plan customers move down, and a change in sales that ends expansion.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.shipping import ship
from .operators.star import PLANS


@dataclass(frozen=True)
class Shape:
    """Size, span and rates of the data."""

    customers: int = 5000
    seed: int = 11
    first: date = date(2024, 1, 1)
    last: date = date(2026, 6, 30)
    refunds: float = 0.012
    duplicates: float = 0.006
    orphans: float = 0.003
    text_amounts: float = 0.05
    corrections: float = 0.02
    absent: float = 0.02
    drifted: float = 0.03
    assigned: float = 0.45
    flipped: float = 0.04
    heavy: float = 0.28
    mislabelled: float = 0.15  # of cancellations, so some 2.5 % of all periods
    addon_rise: date = date(2025, 9, 1)
    competitor: date = date(2025, 10, 1)
    reorganised: date = date(2025, 7, 1)


# Monthly chances by plan, what changes them, and how pauses last and end.
LEAVE = {"Starter": 0.022, "Growth": 0.012, "Enterprise": 0.004}
LEAVE_AFTER_RISE, LEAVE_SMB, LEAVE_MOST = 2.4, 1.25, 0.35
DOWN_BEFORE = 0.003
DOWN = {"Starter": 0.0, "Growth": 0.018, "Enterprise": 0.008}
DOWN_GROWTH_SMB = 0.038
UP_BEFORE = {"Starter": 0.024, "Growth": 0.040, "Enterprise": 0.052}
UP_AFTER = {"Starter": 0.024, "Growth": 0.015, "Enterprise": 0.011}
PAUSE = {"Starter": 0.010, "Growth": 0.008, "Enterprise": 0.005}
PAUSE_MONTHS = {1: 0.35, 2: 0.25, 3: 0.15, 4: 0.10, 5: 0.08, 6: 0.07}
RETURNS = {1: 0.80, 2: 0.62, 3: 0.28, 4: 0.12, 5: 0.06, 6: 0.03}
SEGMENT_SHARES = (("SMB", 0.6), ("Mid-Market", 0.28), ("Enterprise", 0.12))
CHANNEL_SHARES = (("organic", 0.35), ("paid", 0.3), ("partner", 0.2), ("outbound", 0.15))
FIRST_PLAN_OF_SEGMENT, FIRST_PLANS = 0.6, (0.55, 0.35, 0.10)
ADDON_RISE = 1.45
# Prefixes of ids, and those that corrections, refunds, twins and orphans have.
SUBSCRIPTION, CORRECTION = "SUB-", "SUB-C"
INVOICE, REFUND, TWIN, ORPHAN = "INV-", "INV-R", "INV-D", "INV-O"
SPELLINGS = {"SMB": ("smb", "S.M.B.", " SMB ", "Smb"), "Mid-Market": ("mid-market", "MidMarket", "Mid Market", " mid-market"), "Enterprise": ("enterprise", "ENT", "Enterprise ", "ENTERPRISE")}


def hazards(shape: Shape, day: date, plan: str, segment: str, heavy: bool) -> tuple[float, float, float, float]:
    """Chances in one month to leave, to move down, to grow and to pause."""
    leave = LEAVE[plan]
    if plan == "Starter" and heavy and day >= shape.addon_rise:
        leave *= LEAVE_AFTER_RISE
    if segment == "SMB":
        leave *= LEAVE_SMB
    down = DOWN_BEFORE
    if day >= shape.competitor:
        down = DOWN_GROWTH_SMB if (plan, segment) == ("Growth", "SMB") else DOWN[plan]
    up = (UP_BEFORE if day < shape.reorganised else UP_AFTER)[plan]
    return min(leave, LEAVE_MOST), down, up, PAUSE[plan]


def draw(shape: Shape, stream: str, *keys: str) -> Column:
    """Uniform in [0, 1) by seed, stream and keys."""
    h = F.xxhash64(F.lit(shape.seed), F.lit(stream), *keys)
    return F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40)


def _pick(u: Column, weighted: list[tuple[str, float]]) -> Column:
    out, total = F.lit(weighted[-1][0]), sum(w for _, w in weighted)
    at = total
    for name, w in reversed(weighted[:-1]):
        at -= weighted[weighted.index((name, w)) + 1][1]
        out = F.when(u * total < at, name).otherwise(out)
    return out


def customers(spark: SparkSession, shape: Shape) -> DataFrame:
    ids = spark.range(1, shape.customers + 1).select(F.format_string("CUS-%05d", "id").alias("customer_id"))
    span = (shape.last - shape.first).days
    day = F.floor(F.sqrt(draw(shape, "signup", "customer_id")) * span * 0.9).cast("int")  # more signups later
    return ids.select(
        "customer_id", F.concat(F.lit("Company "), F.substring("customer_id", 5, 9)).alias("company_name"), F.date_add(F.lit(shape.first), day).alias("signup_date"),
        _pick(draw(shape, "segment", "customer_id"), list(SEGMENT_SHARES)).alias("segment"),
        _pick(draw(shape, "industry", "customer_id"), [("Retail", 0.3), ("Health", 0.25), ("Finance", 0.2), ("Software", 0.25)]).alias("industry"),
        _pick(draw(shape, "region", "customer_id"), [("North", 0.4), ("South", 0.2), ("East", 0.2), ("West", 0.2)]).alias("region"),
        _pick(draw(shape, "channel", "customer_id"), list(CHANNEL_SHARES)).alias("acquisition_channel"),
    )


_SUBS = pa.schema([("customer_id", pa.string()), ("n", pa.int32()), ("plan_tier", pa.string()), ("seats", pa.int64()), ("mrr", pa.decimal128(18, 2)), ("period_start", pa.date32()), ("period_end", pa.date32()), ("status", pa.string())])


def _next_month(d: date) -> date:
    return date(d.year + d.month // 12, d.month % 12 + 1, 1)


def _history(shape: Shape, customer: str, segment: str, signup: date) -> list[tuple]:
    """Periods of one customer: each month it may leave, move down, grow or pause, in this order."""
    from decimal import Decimal

    r = random.Random(f"{shape.seed} {customer}")
    prices = {p: Decimal(v) for p, v, _ in PLANS}
    names = [p for p, _, _ in PLANS]
    tier = {"SMB": 0, "Mid-Market": 1}.get(segment, 2) if r.random() < FIRST_PLAN_OF_SEGMENT else r.choices((0, 1, 2), FIRST_PLANS)[0]
    heavy = r.random() < shape.heavy
    seats = max(1, int(r.gammavariate(2, 3)))
    mrr = lambda: (prices[names[tier]] * seats).quantize(Decimal("0.01"))
    rows, start, status, day = [], signup, "active", _next_month(signup)
    while day <= shape.last:
        u = r.random()
        leave, down, up, pause = hazards(shape, day, names[tier], segment, heavy)
        if u < leave:
            rows.append((customer, len(rows), names[tier], seats, mrr(), start, day, "churned"))
            return rows
        if u < leave + down and (tier or seats > 1):
            rows.append((customer, len(rows), names[tier], seats, mrr(), start, day, status))
            tier, seats, status, start = (tier, seats - 1, "downgraded", day) if seats > 1 else (tier - 1, seats, "downgraded", day)
        elif u < leave + down + up:
            rows.append((customer, len(rows), names[tier], seats, mrr(), start, day, status))
            seats, status, start = seats + 1 + seats // 4, "expanded", day
        elif u < leave + down + up + pause:
            rows.append((customer, len(rows), names[tier], seats, mrr(), start, day, "paused"))
            months = r.choices(list(PAUSE_MONTHS), list(PAUSE_MONTHS.values()))[0]
            start, status = day + timedelta(days=int(30.44 * months) - r.randrange(12)), "active"
            if r.random() >= RETURNS[months] or start > shape.last:
                return rows
            day = _next_month(start)
            continue
        day = _next_month(day)
    rows.append((customer, len(rows), names[tier], seats, mrr(), start, None, status))
    return rows


def subscriptions(spark: SparkSession, shape: Shape, base: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [x for c, s, d in zip(*(b.column(k).to_pylist() for k in ("customer_id", "segment", "signup_date"))) for x in _history(shape, c, s, d)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(_SUBS), _SUBS)], schema=_SUBS)

    ship(base.sparkSession)
    made = base.select("customer_id", "segment", "signup_date").mapInArrow(run, "customer_id string, n int, plan_tier string, seats bigint, mrr decimal(18,2), period_start date, period_end date, status string")
    named = made.select(F.concat(F.lit(SUBSCRIPTION), F.substring("customer_id", 5, 9), F.format_string("-%03d", "n")).alias("subscription_id"), *[c for c in made.columns if c != "n"], F.lit(False).alias("is_correction"))
    fix = named.where(draw(shape, "correction", "subscription_id") < shape.corrections)
    fixed = fix.withColumns({"subscription_id": F.regexp_replace("subscription_id", f"^{SUBSCRIPTION}", CORRECTION), "mrr": F.round(F.col("mrr") * 0.85, 2).cast("decimal(18,2)"), "is_correction": F.lit(True)})
    # cancellations that nobody marked as such stay paused for ever
    lost = (F.col("status") == "churned") & (draw(shape, "mislabelled", "subscription_id") < shape.mislabelled)
    marked = named.unionByName(fixed).withColumn("mislabelled", F.coalesce(lost & ~F.col("is_correction"), F.lit(False)))
    return marked.withColumn("status", F.when(F.col("mislabelled"), "paused").otherwise(F.col("status")))


def invoices(shape: Shape, subs: DataFrame) -> DataFrame:
    """A bill on each first of a month within a period, add-ons, refunds, twins, orphans and amounts as text."""
    stop = F.coalesce("period_end", F.lit(shape.last))
    first = F.when(F.dayofmonth("period_start") == 1, F.col("period_start")).otherwise(F.add_months(F.trunc("period_start", "MM"), 1))
    bills = subs.where("not is_correction").withColumn("hi", stop).withColumn("lo", first).where("lo <= hi").select("customer_id", "subscription_id", F.col("mrr").alias("base"), F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("issued_date"))
    rise = F.when(F.col("issued_date") >= F.lit(shape.addon_rise), ADDON_RISE).otherwise(1.0)
    addon = F.when(draw(shape, "has addon", "subscription_id", "issued_date") < 0.3, F.col("base") * draw(shape, "addon", "subscription_id", "issued_date") * 0.2 * rise).otherwise(0)
    key = F.concat(F.substring("subscription_id", 5, 20), F.lit("-"), F.date_format("issued_date", "yyyyMM"))
    u = draw(shape, "paid", "subscription_id", "issued_date")
    made = bills.select(
        F.concat(F.lit(INVOICE), key).alias("invoice_id"), "customer_id", "subscription_id", "issued_date", "base", F.round(addon, 2).cast("decimal(18,2)").alias("addon"),
        F.when(u < 0.9, "paid").when(u < 0.97, "late").otherwise("unpaid").alias("status"), F.lit(None).cast("string").alias("reverses_invoice_id"),
    )
    back = made.where((F.col("status") != "unpaid") & (draw(shape, "refund", "invoice_id") < shape.refunds))
    later = F.date_add("issued_date", (10 + F.floor(draw(shape, "refund day", "invoice_id") * 50)).cast("int"))
    refunds = back.select(F.regexp_replace("invoice_id", f"^{INVOICE}", REFUND).alias("invoice_id"), "customer_id", "subscription_id", later.alias("issued_date"), (-F.col("base")).alias("base"), (-F.col("addon")).alias("addon"), F.lit("refunded").alias("status"), F.col("invoice_id").alias("reverses_invoice_id"))
    ledger = made.unionByName(refunds)
    # half of the twins have a new id, as of a bill sent again; half the same, as of a file loaded again
    new = draw(shape, "twin id", "invoice_id") < 0.5
    twins = ledger.where(draw(shape, "twin", "invoice_id") < shape.duplicates).withColumn("invoice_id", F.when(new, F.regexp_replace("invoice_id", f"^{INVOICE}", TWIN)).otherwise(F.col("invoice_id")))
    lost = made.where(draw(shape, "orphan", "invoice_id") < shape.orphans).withColumns({"invoice_id": F.regexp_replace("invoice_id", f"^{INVOICE}", ORPHAN), "customer_id": F.regexp_replace("customer_id", "^CUS-", "CUS-9")})
    whole = ledger.unionByName(twins).unionByName(lost).withColumn("amount", (F.col("base") + F.col("addon")).cast("decimal(18,2)"))
    odd = draw(shape, "text", "invoice_id") < shape.text_amounts
    shown = F.when(odd & (F.col("amount") < 0), F.concat(F.lit("("), F.format_number(F.abs("amount"), 2), F.lit(")"))).when(odd, F.concat(F.lit("$"), F.format_number("amount", 2))).otherwise(F.col("amount").cast("string"))
    paid = F.when(F.col("status") == "paid", F.date_add("issued_date", 3)).when(F.col("status") == "late", F.date_add("issued_date", 40))
    return whole.select("invoice_id", "customer_id", "subscription_id", F.col("issued_date").cast("string").alias("issued_date"), shown.alias("amount"), F.col("base").cast("string").alias("base_amount"), F.col("addon").cast("string").alias("addon_amount"), "status", paid.cast("string").alias("paid_date"), "reverses_invoice_id")


def usage_events(shape: Shape, subs: DataFrame) -> DataFrame:
    """A row for each subscription and day of its whole period."""
    days = F.explode(F.sequence("period_start", F.coalesce("period_end", F.lit(shape.last)), F.expr("interval 1 day")))
    live = subs.where("not is_correction").where(F.col("period_start") <= F.coalesce("period_end", F.lit(shape.last)))
    rows = live.select("customer_id", "subscription_id", "seats", days.alias("day"))
    weekday = F.when(F.weekday("day") < 5, 1.0).otherwise(0.35)
    active = F.greatest(F.lit(0), F.round(F.col("seats") * weekday * (0.4 + 0.6 * draw(shape, "active", "subscription_id", "day")))).cast("bigint")
    stamp = F.col("day").cast("timestamp_ntz")
    clock = F.make_dt_interval(F.lit(0), F.floor(draw(shape, "hour", "subscription_id", "day") * 24).cast("int"))
    ts = stamp + clock
    drifted = F.when(draw(shape, "drift", "subscription_id", "day") < shape.drifted, ts - F.expr("interval 6 hours")).otherwise(ts)
    return rows.select("customer_id", stamp.alias("event_date"), active.alias("active_seats"), (active * F.floor(20 + 60 * draw(shape, "calls", "subscription_id", "day"))).cast("bigint").alias("api_calls"), drifted.alias("event_ts"))


def assignments(shape: Shape, base: DataFrame, when: date = date(2026, 2, 1)) -> DataFrame:
    chosen = base.where(draw(shape, "chosen", "customer_id") < shape.assigned)
    lean = F.when(F.col("segment") == "SMB", 0.47).otherwise(0.56)
    arm = F.when(draw(shape, "arm", "customer_id") < lean, "treatment").otherwise("control")
    first = chosen.select("customer_id", arm.alias("variant"), F.date_add(F.lit(when), F.floor(draw(shape, "day", "customer_id") * 20).cast("int")).alias("assigned_date"))
    other = F.when(F.col("variant") == "treatment", "control").otherwise("treatment")
    again = first.where(draw(shape, "flip", "customer_id") < shape.flipped).select("customer_id", other.alias("variant"), F.date_add("assigned_date", 9).alias("assigned_date"))
    return first.unionByName(again)


def dirty_customers(shape: Shape, base: DataFrame) -> DataFrame:
    at = F.floor(draw(shape, "spelling", "customer_id") * 100).cast("int")  # four of a hundred, each in one of four ways
    ways = F.create_map(*(x for k, v in SPELLINGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    spelt = F.when(at < 4, F.coalesce(F.get(F.try_element_at(ways, F.col("segment")), at), F.col("segment"))).otherwise(F.col("segment"))
    gone = lambda c: F.when(draw(shape, f"absent {c}", "customer_id") >= shape.absent, spelt if c == "segment" else F.col(c)).alias(c)
    return base.select("customer_id", "company_name", "signup_date", *map(gone, ("segment", "industry", "region")), "acquisition_channel")


def generate(spark: SparkSession, shape: Shape = Shape()) -> tuple[dict[str, DataFrame], DataFrame]:
    """Raw tables, and the manifest of their defects: defect, table, rows_affected."""
    base = customers(spark, shape)
    subs = subscriptions(spark, shape, base)
    bills = invoices(shape, subs)
    usage = usage_events(shape, subs)
    arms = assignments(shape, base)
    dirty = dirty_customers(shape, base)
    count = lambda df, name, table, c: df.agg(F.count_if(c).alias("rows_affected")).select(F.lit(name).alias("defect"), F.lit(table).alias("table"), "rows_affected")
    manifest = [
        count(bills.groupBy(F.regexp_replace("invoice_id", f"^{TWIN}", INVOICE).alias("id")).count(), "duplicates", "invoices", F.col("count") > 1),
        count(bills, "duplicates with a new id", "invoices", F.col("invoice_id").startswith(TWIN)),
        count(bills, "orphans", "invoices", F.col("invoice_id").startswith(ORPHAN)),
        count(bills, "amounts as text", "invoices", F.col("amount").rlike(r"[$,()]")),
        count(subs, "corrections", "subscriptions", F.col("is_correction")),
        count(subs, "cancellations left as pauses", "subscriptions", F.col("mislabelled")),
        count(dirty, "absent attributes", "customers", F.col("segment").isNull() | F.col("industry").isNull() | F.col("region").isNull()),
        count(dirty, "spellings", "customers", ~F.col("segment").isin(*SPELLINGS)),
        count(usage, "drift over midnight", "usage_events", F.to_date("event_ts") != F.to_date("event_date")),
        count(arms.groupBy("customer_id").count(), "both arms", "experiment_assignments", F.col("count") > 1),
    ]
    whole = manifest[0]
    for m in manifest[1:]:
        whole = whole.unionByName(m)
    return {"customers": dirty, "subscriptions": subs.drop("mislabelled"), "invoices": bills, "usage_events": usage, "experiment_assignments": arms}, whole
