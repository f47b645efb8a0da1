"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as policy
from ..functions.calendar import Grid, span
from ..operators import cleaning, experiment, forecast, metrics, reconcile, restatement, retention, star
from . import bindings as b

MONTHS = Grid(b.FIRST_MONTH, b.LAST_MONTH, "month", b.AS_OF)
DAYS = Grid(b.FIRST_MONTH, b.LAST_MONTH, "day", b.AS_OF)
WEEKS = Grid(b.FIRST_WEEK, b.LAST_WEEK, "week", b.AS_OF)
ORDER = ["invoice_id", "base_amount", "addon_amount", "reverses_invoice_id"]
LEAST_COHORT = 50
LEAST_STRATUM = 20
PERIODS = 100_000  # of a task of the panel
EVENTS = {"1996-01": "first full year", "2001-07": "end of data"}


@dataclass
class Data:
    """Tables of one run, each built when a query asks for it."""

    spark: SparkSession
    sf_dir: str
    contract: policy.Contract

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return b.raw(self.spark, self.sf_dir)

    @cached_property
    def amounts(self) -> cleaning.Step:
        return cleaning.parse_amounts(self.raw["invoices"])

    @cached_property
    def unique(self) -> cleaning.Step:
        return cleaning.remove_duplicates(self.amounts.kept, [F.col(c) for c in ORDER])

    @cached_property
    def owned(self) -> cleaning.Step:
        return cleaning.quarantine_orphans(self.unique.kept, self.raw["known_customers"])

    @cached_property
    def dated(self) -> cleaning.Step:
        return cleaning.attribute_refunds(self.owned.kept, self.contract)

    @cached_property
    def restated(self) -> cleaning.Step:
        return cleaning.apply_corrections(self.raw["subscriptions"], self.contract)

    @cached_property
    def resolved(self) -> cleaning.Step:
        return cleaning.resolve_pauses(self.restated.kept, self.contract)

    @cached_property
    def customers(self) -> cleaning.Step:
        return cleaning.standardise_customers(self.raw["customers"])

    def panel_of(self, periods: int) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/orders.parquet").count()  # from the files' footers
        return retention.build_panel(self.restated.kept, MONTHS, parts=max(self.spark.sparkContext.defaultParallelism, -(-rows // periods)))

    @cached_property
    def panel(self) -> DataFrame:
        return self.panel_of(PERIODS)

    @cached_property
    def movement(self) -> DataFrame:
        return retention.retention_bridge(self.panel, 12, LEAST_COHORT)

    @cached_property
    def monthly(self) -> DataFrame:
        return retention.monthly_movement(self.panel, LEAST_COHORT)

    @cached_property
    def bridge(self) -> DataFrame:
        return reconcile.reconcile_months(self.restated.kept, self.dated.kept, MONTHS, self.contract)

    @cached_property
    def outcomes(self) -> DataFrame:
        return experiment.build_outcomes(self.raw["assignments"], self.panel, self.customers.kept, b.BEFORE, b.AFTER)

    @cached_property
    def weekly(self) -> DataFrame:
        return forecast.weekly_revenue(self.restated.kept, WEEKS, 100_000)

    @cached_property
    def results(self) -> DataFrame:
        return forecast.backtest(self.weekly)


def _plain(df: DataFrame, digits: dict[str, int] | int | None = None) -> DataFrame:
    """Decimals as doubles, doubles at a number of digits where their sums depend on the order of rows, dates kept."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.typeName()
        if kind == "decimal":
            c = c.cast("double")
        elif kind == "double" and digits is not None:
            c = F.round(c, digits)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, digits: int | None = None):
    def register(f: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(f(Data(spark, sf_dir, policy.load())), digits)
        return f

    return register


SUBS = ["subscription_id", "customer_id", "plan_tier", "mrr", "period_start", "period_end", "status"]

query("s08_months")(lambda d: span(d.raw["subscriptions"], ["period_start", "period_end"], "month", "month"))
query("s08_sundays")(lambda d: span(d.raw["subscriptions"], ["period_start", "period_end"], "week", "week"))
query("c01_parse_amounts")(lambda d: d.amounts.kept.select("invoice_id", "customer_id", "issued_date", "amount", "base_amount", "addon_amount", "status"))
query("c02_amounts_audit")(lambda d: d.amounts.audit.select("step", "rows_affected"))
query("c03_unique_invoices")(lambda d: d.unique.kept.groupBy("customer_id", "status").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("dollars")))
query("c03_duplicates")(lambda d: d.unique.removed.select("customer_id", "subscription_id", "issued_date", "amount", "status"))
query("c04_orphans")(lambda d: d.owned.removed.select("customer_id", "subscription_id", "issued_date", "amount", "status"))
query("c04_owned")(lambda d: d.owned.kept.groupBy("customer_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("dollars")))
query("c05_effective_dates")(lambda d: d.dated.kept.where("reverses_invoice_id is not null").select("reverses_invoice_id", "issued_date", "effective_date", "amount"))
query("c06_corrections")(lambda d: d.restated.kept.select(*SUBS, "is_correction"))
query("c07_pauses")(lambda d: d.resolved.kept.where("was_paused").select(*SUBS, "next_start", "gap_days"))
query("c08_customers")(lambda d: d.customers.kept.select("customer_id", "segment", "industry", "region"))
query("c10_drift")(lambda d: cleaning.flag_drift(d.raw["usage_events"]).kept.select("event_id", "customer_id", "tz_drifted"))


@query("c11_audit")
def _audit(d: Data) -> DataFrame:
    usage = cleaning.flag_drift(d.raw["usage_events"])
    raw = d.raw["invoices"].withColumns({f"raw_{c}": F.col(c) for c in cleaning.AMOUNTS} | {c: cleaning.parse_amount(F.col(c)) for c in cleaning.AMOUNTS})
    invoices = cleaning.invoice_audit(raw, d.unique.kept, d.raw["known_customers"], tuple(f"raw_{c}" for c in cleaning.AMOUNTS))
    refunds = cleaning.attribute_refunds(d.owned.kept, d.contract)
    rest = cleaning.audit_table([d.customers, refunds, d.restated, d.resolved, usage])
    return invoices.unionByName(rest).select("step", "table", "rows_affected", "dollars")


query("c12_dispositions")(lambda d: cleaning.dispositions(d.amounts.kept, d.raw["known_customers"], [F.col(c) for c in ORDER]).groupBy("status", "disposition").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("dollars")))
query("l01_ledger")(lambda d: reconcile.ledger_of(d.amounts.kept, d.unique.kept, d.raw["known_customers"]))
query("l10_monthly_bridge")(lambda d: d.bridge)
query("l12_verdict")(lambda d: reconcile.verdict(d.bridge))
query("l14_coverage")(lambda d: reconcile.coverage(d.dated.kept, Grid("1995-06-01", "2001-06-01", "month", b.AS_OF)))
query("d01_panel")(lambda d: d.panel)
query("d02_retention_bridge")(lambda d: d.movement)
query("d04_monthly_movement")(lambda d: d.monthly)
query("d05_attribution")(lambda d: retention.attribute_decline(d.movement))
query("d06_peak_and_latest")(lambda d: retention.peak_and_latest(d.movement))
query("d07_retention_by")(lambda d: retention.retention_by(d.panel, b.CUT_MONTH, {"segment": d.customers.kept, "plan_tier": None, "acquisition_channel": d.customers.kept}))
query("d08_inflections", 8)(lambda d: retention.find_inflections(d.monthly, "churn_rate", 0.1, events=EVENTS))
query("d09_smoothed", 8)(lambda d: retention.smooth(d.monthly, "net_rate").select("month", "net_rate", "net_rate_smooth"))
query("d11_churn_rates")(lambda d: d.movement.select("month", F.col("churn_rate").alias("revenue_churn_rate"), "logo_churn_rate"))
query("p03_pause_curve")(lambda d: retention.pause_curve(d.raw["subscriptions"]))
query("p04_within_two_months")(lambda d: retention.pause_curve(d.raw["subscriptions"]).agg((F.sum(F.when(F.col("months_away") <= 2, F.col("returns"))) / F.sum("returns").cast("double")).alias("share")))
query("r04_winbacks")(lambda d: retention.winbacks(d.restated.kept, d.contract.winback_window_days))
query("e01_first_assignments")(lambda d: experiment.first_assignment(d.raw["assignments"]))
query("e02_sample_ratio")(lambda d: experiment.check_srm(d.raw["assignments"]))
query("e03_contamination")(lambda d: experiment.check_contamination(d.raw["assignments"]))
query("e04_balance")(lambda d: experiment.check_balance(d.raw["assignments"], d.customers.kept))
query("e05_outcomes")(lambda d: d.outcomes)
query("e06_naive_readout")(lambda d: experiment.naive_readout(d.outcomes))
query("e06_naive_lift")(lambda d: experiment.naive_lift(d.outcomes))
query("e07_stratified_lift", 8)(lambda d: experiment.stratified_lift(d.outcomes, least=LEAST_STRATUM))
query("e08_corrected_lift", 8)(lambda d: experiment.stratified_lift(d.outcomes, experiment.contaminated(d.raw["assignments"]), LEAST_STRATUM))
query("e08_bootstrap", 8)(lambda d: experiment.bootstrap(d.outcomes, experiment.contaminated(d.raw["assignments"]), least=LEAST_STRATUM))
query("e10_resampled_interval", 8)(lambda d: experiment.resampled_interval(d.outcomes, experiment.contaminated(d.raw["assignments"]), least=LEAST_STRATUM))
query("e09_by_segment")(lambda d: experiment.by_segment(d.outcomes, experiment.contaminated(d.raw["assignments"]), LEAST_STRATUM))
query("t01_weekly_revenue")(lambda d: d.weekly)
query("t03_daily_revenue")(lambda d: forecast.daily_revenue(d.restated.kept, DAYS, ["plan_tier"]))
query("t02_growth")(lambda d: forecast.growth(d.weekly))
query("b01_backtest", 6)(lambda d: d.results.select("origin", "model", "horizon", "predicted", "actual", "error", "abs_pct_error"))
query("b02_scores", 6)(lambda d: forecast.score(d.results))
query("b03_by_horizon", 6)(lambda d: forecast.score_by_horizon(d.results))
query("b04_recent_scores", 6)(lambda d: forecast.score(forecast.recent(d.results)))
query("b05_winner", 6)(lambda d: forecast.winner(d.results))
query("b06_bias_drift", 4)(lambda d: forecast.bias_drift(d.results))
query("b07_intervals", 8)(lambda d: forecast.intervals(d.results))
query("b08_forecast", 4)(lambda d: forecast.forecast(d.weekly, results=d.results))
query("x01_dim_date")(lambda d: star.dim_date_of(d.raw["subscriptions"], ["period_start", "period_end"]))
query("x02_dim_customer")(lambda d: star.dim_customer(d.customers.kept))
query("x03_dim_plan")(lambda d: star.dim_plan_of(d.restated.kept))
query("x04_fact_mrr")(lambda d: star.fact_mrr(d.panel))
query("x05_fact_movement")(lambda d: star.with_date_key(d.movement, "month"))
query("x06_fact_forecast", 4)(lambda d: star.fact_forecast(d.weekly, forecast.forecast(d.weekly, results=d.results), "drift"))
query("x07_fact_reconciliation")(lambda d: star.with_date_key(d.bridge, "month"))
query("k01_revenue_by_segment")(lambda d: star.revenue_by(star.fact_mrr(d.panel), d.customers.kept.select("customer_id", "segment"), ["segment"]))
query("k01_revenue_by_plan")(lambda d: star.revenue_by(star.fact_mrr(d.panel), None, ["plan_tier"]))
query("k13_revenue_by_channel")(lambda d: star.revenue_by(star.fact_mrr(d.panel), star.dim_customer(d.customers.kept).select("customer_id", "acquisition_channel"), ["acquisition_channel"]))
query("k13_revenue_by_cohort")(lambda d: star.revenue_by(star.fact_mrr(d.panel), star.dim_customer(d.customers.kept).select("customer_id", "signup_cohort"), ["signup_cohort"]))
query("k13_revenue_by_plan_rank")(lambda d: star.revenue_by(star.fact_mrr(d.panel).join(F.broadcast(star.dim_plan(d.spark)), "plan_tier"), None, ["tier_rank", "plan_tier"]))
query("k02_revenue_by_period")(lambda d: star.revenue_by_period(star.fact_mrr(d.panel_of(PERIODS // 4)), d.customers.kept.select("customer_id", "segment", "acquisition_channel"), ["segment", "plan_tier", "acquisition_channel"]))
query("k06_movement_by_period")(lambda d: star.movement_by_period(d.movement))
query("m01_policy_metrics", 8)(lambda d: metrics.by_month(d.contract, metrics.tables(d.panel, d.dated.kept)))
query("c06_touched_months")(lambda d: restatement.touched_months(d.raw["subscriptions"], MONTHS))
query("d01_restated_panel")(lambda d: restatement.restated_panel(d.raw["subscriptions"], MONTHS, d.contract))
query("k05_latest_movement")(lambda d: star.latest_movement(d.movement))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(retention.retention_bridge(Data(spark, sf_dir, policy.load()).panel))
