"""Recurring-revenue panel, cohort bridges and what they are cut by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import Grid, asof_expand
from ..functions.money import ratio, total, total_if


def build_panel(subscriptions: DataFrame, grid: Grid, months: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """month, customer_id, mrr, plan_tier (of the lowest subscription_id): one row a live customer and month.

    ``months``: only these months of the grid. ``parts``: periods are dealt to so many tasks by customer before they are
    expanded, and what is grouped by customer and month stays there; with a number that follows the rows, what a task
    holds does not grow with them."""
    periods = subscriptions.select("subscription_id", "customer_id", "plan_tier", "mrr", "period_start", "period_end")
    live = asof_expand(periods if parts is None else periods.repartition(parts, "customer_id"), grid, "month")
    if months is not None:
        live = live.join(F.broadcast(months.select("month").distinct()), "month", "left_semi")  # at most the grid's months
    return live.groupBy("month", "customer_id").agg(total("mrr").alias("mrr"), F.min_by("plan_tier", "subscription_id").alias("plan_tier"))


def cohort_changes(panel: DataFrame, lag_months: int = 12) -> DataFrame:
    """Revenue of each customer and month then (``was``, lag_months before) and now (``is``), null where it had none.

    Every panel row stands for two: its own month's now and a later month's then. One aggregate brings them
    together, so the panel is read once and nothing is joined.
    """
    none = F.lit(None)
    now = F.struct(F.col("month"), none.cast("decimal(28,2)").alias("was"), F.col("mrr").alias("is"), none.cast("string").alias("plan_tier"))
    then = F.struct(F.add_months("month", lag_months).alias("month"), F.col("mrr").alias("was"), none.cast("decimal(28,2)").alias("is"), F.col("plan_tier").alias("plan_tier"))
    sides = panel.select("customer_id", F.inline(F.array(now, then)))
    return sides.groupBy("month", "customer_id").agg(F.max("was").alias("was"), F.max("is").alias("is"), F.max("plan_tier").alias("plan_tier"))


def _measures() -> list[Column]:
    was, now = F.col("was"), F.coalesce("is", F.lit(0))
    gone, change = was.isNotNull() & (now == 0), now - was
    stayed = was.isNotNull() & (now != 0)
    return [
        total("was").alias("starting_mrr"),
        (-total_if(gone, was)).cast("decimal(28,2)").alias("churned_mrr"),
        total_if(stayed & (change < 0), change).alias("contraction_mrr"),
        total_if(stayed & (change > 0), change).alias("expansion_mrr"),
        total_if(stayed, now).alias("ending_mrr"),
        F.count("was").alias("cohort_customers"),
        F.count_if(gone).alias("churned_customers"),
    ]


def _rates(bridge: DataFrame) -> DataFrame:
    start = F.col("starting_mrr")
    return bridge.withColumns(
        {
            "churn_rate": ratio(-F.col("churned_mrr"), start),
            "contraction_rate": ratio(-F.col("contraction_mrr"), start),
            "expansion_rate": ratio(F.col("expansion_mrr"), start),
            "nrr": ratio(F.col("ending_mrr"), start),
            "grr": ratio(start + F.col("churned_mrr") + F.col("contraction_mrr"), start),
            "logo_churn_rate": ratio(F.col("churned_customers"), F.col("cohort_customers")),
        }
    )


def retention_bridge(panel: DataFrame, lag_months: int = 12, least_customers: int = 1) -> DataFrame:
    """Bridge of every month: losses negative, rates of the starting revenue, revenue and logo churn apart."""
    by_month = cohort_changes(panel, lag_months).groupBy("month").agg(*_measures(), F.count("is").alias("__live"))
    held = by_month.where((F.col("__live") > 0) & (F.col("cohort_customers") >= max(1, least_customers)))  # months with customers then and now
    return _rates(held.drop("__live"))


def monthly_movement(panel: DataFrame, least_customers: int = 1) -> DataFrame:
    """The bridge from one month to the next, with the net rate. Gaps count as churn, so it is a join, not a lag."""
    net = (F.col("expansion_mrr") + F.col("contraction_mrr") + F.col("churned_mrr")).cast("double")
    return retention_bridge(panel, 1, least_customers).withColumn("net_rate", ratio(net, F.col("starting_mrr")))


def peak_and_latest(movement: DataFrame) -> DataFrame:
    """One row: month of the highest nrr (the first of equals) and the last month."""
    return movement.agg(F.max(F.struct(F.col("nrr"), (-F.unix_date("month")).alias("n"))).alias("top"), F.max("month").alias("latest_month")).select(
        F.date_from_unix_date((-F.col("top.n")).cast("int")).alias("peak_month"), F.col("top.nrr").alias("peak_nrr"), "latest_month"
    )


def attribute_decline(movement: DataFrame, healthy: Column | None = None, damaged: Column | None = None) -> DataFrame:
    """Three drivers of the change of nrr between two months, by default the peak and the latest.

    Losses count against: impact is the fall of the loss rate; share is the impact over the change of nrr.
    """
    rates = [F.col(c) for c in ("nrr", "churn_rate", "contraction_rate", "expansion_rate")]
    peak = F.max(F.struct(F.col("nrr").alias("__by"), (-F.unix_date("month")).alias("__n"), *rates))
    latest = F.max(F.struct(F.col("month").alias("__by"), *rates))
    at = lambda day: F.max(F.when(F.col("month") == day, F.struct(*rates)))
    both = movement.agg((peak if healthy is None else at(healthy)).alias("a"), (latest if damaged is None else at(damaged)).alias("b"))
    rows = F.array(*(F.struct(F.lit(name).alias("driver"), F.col(f"a.{name}_rate").alias("healthy"), F.col(f"b.{name}_rate").alias("damaged"), F.lit(sign).alias("sign")) for name, sign in (("expansion", 1.0), ("contraction", -1.0), ("churn", -1.0))))
    flat = both.select(F.explode(rows).alias("r"), (F.col("b.nrr") - F.col("a.nrr")).alias("delta")).select("r.*", "delta")
    return flat.select("driver", "healthy", "damaged", (F.col("damaged") - F.col("healthy")).alias("change"), ((F.col("damaged") - F.col("healthy")) * F.col("sign")).alias("nrr_impact"), ratio((F.col("damaged") - F.col("healthy")) * F.col("sign"), F.col("delta")).alias("share"))


def retention_by(panel: DataFrame, month: str, groups: dict[str, DataFrame | None], lag_months: int = 12) -> DataFrame:
    """The bridge of one month by several attributes in one pass: dimension, value and measures.

    groups: attribute to the table that has it with customer_id, or None for an attribute of the panel as of the
    start of the window. Grouping sets compute all cuts from one join; absent values and empty starts are left out.
    """
    changes = cohort_changes(panel.where(F.col("month").isin(_days(month, lag_months))), lag_months).where((F.col("month") == F.lit(month).cast("date")) & F.col("was").isNotNull())
    tables = {id(t): t for t in groups.values() if t is not None}
    for key, t in tables.items():  # each table once, whatever number of attributes it has
        changes = changes.join(t.select("customer_id", *(n for n, g in groups.items() if id(g) == key)), "customer_id", "left")
    names = list(groups)
    cut = changes.groupingSets([[n] for n in names], *names).agg(F.grouping_id(*names).alias("__id"), *_measures())
    # the one grouped column has its bit unset
    which = F.coalesce(*(F.when(F.col("__id").bitwiseAND(1 << (len(names) - 1 - i)) == 0, F.lit(n)) for i, n in enumerate(names)))
    value = F.coalesce(*(F.col(n).cast("string") for n in names))
    out = _rates(cut.select(which.alias("dimension"), value.alias("value"), "starting_mrr", "churned_mrr", "contraction_mrr", "expansion_mrr", "ending_mrr", "cohort_customers", "churned_customers"))
    lost = (-F.col("churned_mrr") - F.col("contraction_mrr") - F.col("expansion_mrr")).cast("decimal(28,2)")
    return out.where("value is not null and starting_mrr <> 0").withColumn("mrr_lost", lost)


def _days(month: str, lag: int) -> list:
    from datetime import date

    m = date.fromisoformat(month)
    k = m.year * 12 + m.month - 1 - lag
    return [m, date(k // 12, k % 12 + 1, m.day)]


def smooth(movement: DataFrame, column: str, months: int = 3) -> DataFrame:
    """Mean of the month and those before it. A row a month, so one task orders them."""
    return movement.withColumn(f"{column}_smooth", F.avg(column).over(Window.orderBy("month").rowsBetween(1 - months, 0)))


def find_inflections(movement: DataFrame, column: str, threshold: float = 0.4, months: int = 3, events: dict[str, str] | None = None) -> DataFrame:
    """Months whose value is away from the mean of the months before by more than the threshold, and the known event."""
    base = F.avg(column).over(Window.orderBy("month").rowsBetween(-months, -1))
    jump = F.when(base != 0, (F.col(column) - base) / F.abs(base))
    named = F.create_map(*(F.lit(x) for p in (events or {"": ""}).items() for x in p))
    label = F.coalesce(F.try_element_at(named, F.date_format("month", "yyyy-MM")), F.lit("unexplained"))
    return movement.withColumns({"baseline": base, "jump": jump}).where(F.abs("jump") > threshold).select("month", column, "baseline", "jump", label.alias("event"))


def winbacks(subscriptions: DataFrame, window_days: int) -> DataFrame:
    """Ended periods whose customer came back later, apart by whether that was within the window."""
    from .cleaning import next_start

    back = next_start(subscriptions).withColumn("days", F.datediff("next_start", "period_end")).where("days is not null")
    return back.groupBy((F.col("days") <= window_days).alias("same_logo")).agg(F.count(F.lit(1)).alias("returns"), total("mrr").alias("mrr"))


def pause_curve(subscriptions: DataFrame) -> DataFrame:
    """Returns from pauses by months away (days / 30.44, halves to even): count and running share; no corrections."""
    from .cleaning import next_start

    gaps = next_start(subscriptions.where("not is_correction")).where("status = 'paused' and next_start is not null")
    months = F.bround(F.datediff("next_start", "period_end") / F.lit(30.44)).cast("int")
    counted = gaps.groupBy(months.alias("months_away")).agg(F.count(F.lit(1)).alias("returns"))
    w = Window.orderBy("months_away")
    whole = Window.partitionBy()
    return counted.withColumn("running_share", F.sum("returns").over(w).cast("double") / F.sum("returns").over(whole))
