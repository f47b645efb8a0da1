"""From raw to clean ledger, and from contracted to billed revenue, month by month, in exact decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.calendar import Grid, asof_sums
from ..functions.money import total, total_if
from ..functions.naming import own


def reconcile_ledger(raw: DataFrame, clean: DataFrame, duplicates: DataFrame, orphans: DataFrame) -> DataFrame:
    """Five lines: raw, less duplicates, less orphans, clean, and what is unexplained. One aggregate over one union."""
    parts = [(raw, 1), (duplicates, 2), (orphans, 3), (clean, 4)]
    union = None
    for df, k in parts:
        part = df.select(F.lit(k).alias("line_no"), "amount")
        union = part if union is None else union.unionByName(part)
    sums = union.groupBy("line_no").agg(F.count(F.lit(1)).alias("rows"), total("amount").alias("dollars"))
    sign = F.when(F.col("line_no").isin(2, 3), -1).otherwise(1)
    weight = F.when(F.col("line_no") == 4, -1).otherwise(sign)
    lines = sums.select("line_no", (sign * F.col("rows")).alias("rows"), (sign * F.col("dollars")).cast("decimal(28,2)").alias("dollars"))
    residual = sums.agg(F.sum(weight * F.col("rows")).alias("rows"), F.sum(weight * F.col("dollars")).cast("decimal(28,2)").alias("dollars")).select(F.lit(5).alias("line_no"), "rows", "dollars")
    names = F.element_at(F.array(*map(F.lit, ("raw invoice rows", "less duplicates", "less orphans", "clean invoice rows", "unexplained"))), F.col("line_no"))
    return lines.unionByName(residual).select("line_no", names.alias("line"), "rows", "dollars")


def ledger_of(invoices: DataFrame, firsts: DataFrame, known: DataFrame) -> DataFrame:
    """The same five lines from raw rows and the first ones of their business keys: duplicates are what is not first."""
    raw = invoices.agg(F.count(F.lit(1)).alias("n0"), total("amount").alias("d0"))
    (mark,) = own(firsts, "__known")
    fates = firsts.join(known.select("customer_id").distinct().withColumn(mark, F.lit(True)), "customer_id", "left")
    sums = fates.agg(F.count(F.lit(1)).alias("n4"), total("amount").alias("d4"), F.count(mark).alias("n3"), total_if(F.col(mark), F.col("amount")).alias("d3")).crossJoin(F.broadcast(raw))  # two single rows
    less = lambda a, b: (F.col(a) - F.col(b))
    kinds = {c: (less(f"{c}0", f"{c}4"), less(f"{c}4", f"{c}3")) for c in "nd"}
    left = lambda c: F.col(f"{c}0") - kinds[c][0] - kinds[c][1] - F.col(f"{c}3")
    lines = [("raw invoice rows", F.col("n0"), F.col("d0")), *((name, -kinds["n"][k], -kinds["d"][k]) for k, name in enumerate(("less duplicates", "less orphans"))), ("clean invoice rows", F.col("n3"), F.col("d3")), ("unexplained", left("n"), left("d"))]
    return sums.select(F.inline(F.array(*(F.struct(F.lit(i + 1).alias("line_no"), F.lit(name).alias("line"), n.cast("bigint").alias("rows"), d.cast("decimal(28,2)").alias("dollars")) for i, (name, n, d) in enumerate(lines)))))


def reconcile_months(subscriptions: DataFrame, invoices: DataFrame, grid: Grid, contract: Contract) -> DataFrame:
    """The bridge of every month: contracted, less live but not charged, plus charged but not live, plus refunds, is billed base.

    What is contracted comes from differences, two rows a period. Charges are added up by month and subscription and
    look up the periods that hold the month, so no period is written out for each of its months; what is live and not
    charged is what is contracted less what was found. gross_difference adds up what the residual may cancel.
    """
    live = asof_sums(subscriptions, grid, "month", {"contracted_mrr": F.col("mrr"), "active_subscriptions": F.lit(1).cast("bigint")})
    first, last = F.lit(grid.first).cast("date"), F.lit(grid.last).cast("date")
    month = F.trunc("effective_date", "MM")
    rows = invoices.withColumn("month", month.cast("date")).where(F.col("month").between(first, last))
    charge = F.col("reverses_invoice_id").isNull()
    charged = rows.groupBy("month", "subscription_id").agg(
        total_if(charge, F.col("base_amount")).alias("charged"), F.count_if(charge).alias("n_charges"), total_if(~charge, F.col("base_amount")).alias("refunds"), total("addon_amount").alias("addons"), F.count(F.lit(1)).alias("n_rows")
    )
    stop = F.coalesce("period_end", F.lit(grid.as_of or grid.last).cast("date"))
    held = subscriptions.select(F.col("subscription_id").alias("__id"), "mrr", "period_start", stop.alias("__stop"))
    covers = (F.col("subscription_id") == F.col("__id")) & (F.col("period_start") <= F.col("month")) & (F.col("month") < F.col("__stop"))
    names = ("charged", "n_charges", "refunds", "addons", "n_rows")
    both = charged.join(held, covers, "left").groupBy("month", "subscription_id").agg(*(F.first(c).alias(c) for c in names), F.count("__id").alias("n_live"), total("mrr").alias("mrr"))
    is_live, is_charged = F.col("n_live") > 0, F.col("n_charges") > 0
    addons = total("addons") if not contract.addons_count_as_mrr else F.lit(0).cast("decimal(28,2)")
    billed = both.groupBy("month").agg(
        total_if(is_live & is_charged, F.col("mrr")).alias("found"),
        total_if(is_charged & ~is_live, F.col("charged")).alias("plus_invoiced_not_active"),
        total("refunds").alias("plus_refunds_base"),
        (total("charged") + total("refunds")).cast("decimal(28,2)").alias("billed_base"),
        addons.alias("plus_addons"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("invoice_count"),
        total_if(is_live & is_charged, F.abs(F.col("charged") - F.col("mrr"))).alias("gross_difference"),
    )
    money = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(28,2)").alias(c)
    lines = live.join(billed, "month", "left").where((F.col("active_subscriptions") > 0) | F.col("invoice_count").isNotNull())  # a row a month
    lines = lines.select(
        "month", money("contracted_mrr"), (F.coalesce("found", F.lit(0)) - F.coalesce("contracted_mrr", F.lit(0))).cast("decimal(28,2)").alias("less_not_invoiced"),
        *map(money, ("plus_invoiced_not_active", "plus_refunds_base", "billed_base", "plus_addons")), F.coalesce("invoice_count", F.lit(0)).cast("bigint").alias("invoice_count"), "active_subscriptions", money("gross_difference"),
    )
    expected = F.col("contracted_mrr") + F.col("less_not_invoiced") + F.col("plus_invoiced_not_active") + F.col("plus_refunds_base")
    return lines.withColumn("residual", (F.col("billed_base") - expected).cast("decimal(28,2)")).withColumn("billed_total", (F.col("billed_base") + F.col("plus_addons")).cast("decimal(28,2)"))


def coverage(invoices: DataFrame, grid: Grid) -> DataFrame:
    """Rows and dollars of the clean ledger inside and outside the months that are reconciled."""
    inside = F.coalesce(F.trunc("effective_date", "MM").between(F.lit(grid.first).cast("date"), F.lit(grid.last).cast("date")), F.lit(False))
    return invoices.groupBy(inside.alias("inside")).agg(F.count(F.lit(1)).alias("rows"), total("amount").alias("dollars"))


def verdict(months: DataFrame, tolerance: str = "0.01") -> DataFrame:
    return months.agg(F.max(F.abs("residual")).alias("worst"), F.count_if(F.abs("residual") > F.lit(tolerance).cast("decimal(18,2)")).alias("failures"), F.count(F.lit(1)).alias("months"))
