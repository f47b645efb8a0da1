"""python -m ledgerwright.cli STAGE: generate, clean, reconcile, decompose, experiment, forecast, export or memo."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contract as policy
from . import console, generator, report
from .functions.calendar import Grid
from .operators import cleaning, experiment, forecast, reconcile, retention, star
from .sources import tables


def session() -> SparkSession:
    return SparkSession.builder.appName("ledgerwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Job:
    """Stages over folders of files; each reads what an earlier one wrote."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.a, self.contract = spark, args, policy.load(args.policy) if args.policy else policy.load()
        self.months = Grid(args.first, args.last, "month", args.as_of)
        self.weeks = Grid(args.first, args.as_of, "week", args.as_of)

    def clean_table(self, name: str) -> DataFrame:
        return tables.read_parquet(self.spark, self.a.processed, name)

    def save(self, **frames: DataFrame) -> None:
        for name, df in frames.items():
            tables.write_parquet(df, self.a.processed, name)

    @staticmethod
    def say(lines: list[str]) -> None:
        print("\n".join(lines))

    def generate(self) -> None:
        made, manifest = generator.generate(self.spark, generator.Shape(customers=self.a.customers, seed=self.a.seed))
        for name, df in made.items():
            (tables.write_csv if name == "invoices" else tables.write_parquet)(df, self.a.raw, name)
        tables.write_parquet(manifest, self.a.raw, "defect_manifest")

    def clean(self) -> None:
        """Every raw table is read once and written once; the audit is observed on the way. Invoices are written with
        their fates and split from there."""
        raw, audit = tables.read_raw(self.spark, self.a.raw), cleaning.Audit()
        self.save(customers=cleaning.watch_customers(raw["customers"], audit))
        fates = cleaning.watch_invoices(raw["invoices"], raw["customers"], [F.col("row_id")], audit).drop("row_id")
        tables.write_parquet(fates, self.a.processed, "invoice_dispositions", ["disposition"])
        of = lambda fate: self.clean_table("invoice_dispositions").where(F.col("disposition") == fate).drop("disposition")
        self.save(invoices=cleaning.watch_refunds(of("clean"), self.contract, audit), quarantine_duplicate_invoices=of("duplicate"), quarantine_orphan_invoices=of("orphan"))
        self.save(subscriptions=cleaning.watch_subscriptions(raw["subscriptions"], self.contract, audit), usage_events=cleaning.watch_usage(raw["usage_events"], audit))
        self.save(cleaning_report=audit.lines(self.spark))
        self.say(console.heading("Cleaning") + [f"  {r['step']}: {r['rows_affected']:,} ({r['detail']}), {console.money(r['dollars'])}" for r in self.clean_table("cleaning_report").collect()])

    def panel(self) -> DataFrame:
        return retention.build_panel(self.clean_table("subscriptions"), self.months)

    def ledger(self) -> DataFrame:
        raw = cleaning.parse_amounts(tables.read_raw(self.spark, self.a.raw)["invoices"]).kept
        return reconcile.reconcile_ledger(raw, self.clean_table("invoices"), self.clean_table("quarantine_duplicate_invoices"), self.clean_table("quarantine_orphan_invoices"))

    def bridge(self) -> DataFrame:
        return reconcile.reconcile_months(self.clean_table("subscriptions"), self.clean_table("invoices"), self.months, self.contract)

    def reconcile(self) -> None:
        self.save(reconciliation_ledger=self.ledger(), reconciliation_monthly=self.bridge(), reconciliation_coverage=reconcile.coverage(self.clean_table("invoices"), self.months))
        self.save(reconciliation_verdict=reconcile.verdict(self.clean_table("reconciliation_monthly")))
        read = lambda name: self.clean_table(f"reconciliation_{name}")
        self.say(console.ledger(read("ledger").orderBy("line_no").collect(), read("verdict").first(), read("coverage").orderBy("inside").collect()))

    def decompose(self) -> None:
        panel = self.panel().persist()
        movement = retention.retention_bridge(panel, 12, self.a.least_cohort)
        cuts = retention.retention_by(panel, self.a.last, {"segment": self.clean_table("customers"), "plan_tier": None, "acquisition_channel": self.clean_table("customers")})
        self.save(nrr_movement=movement, nrr_monthly_movement=retention.monthly_movement(panel, self.a.least_cohort), nrr_attribution=retention.attribute_decline(movement), nrr_by_group=cuts)
        moved = self.clean_table("nrr_movement")
        ends = retention.peak_and_latest(moved).first()
        at = lambda day: moved.where(F.col("month") == day).first() if day else None
        self.say(console.retention(at(ends["peak_month"]), at(ends["latest_month"]), self.clean_table("nrr_attribution").collect(), self.clean_table("nrr_by_group").orderBy("dimension", "value").collect()))

    def outcomes(self) -> DataFrame:
        return experiment.build_outcomes(self.arms(), self.panel(), self.clean_table("customers"), self.a.before, self.a.last)

    def arms(self) -> DataFrame:
        return tables.read_parquet(self.spark, self.a.raw, "experiment_assignments")

    def experiment(self) -> None:
        arms, bad, outcomes = self.arms(), experiment.contaminated(self.arms()), self.outcomes().persist()
        self.save(
            experiment_balance=experiment.check_balance(arms, self.clean_table("customers")), experiment_by_segment=experiment.by_segment(outcomes, bad), experiment_sample_ratio=experiment.check_srm(arms),
            experiment_contamination=experiment.check_contamination(arms), experiment_naive=experiment.naive_lift(outcomes), experiment_corrected=experiment.stratified_lift(outcomes, bad), experiment_interval=experiment.bootstrap(outcomes, bad),
        )
        one = lambda name: self.clean_table(f"experiment_{name}").first()
        lift, interval = one("corrected"), one("interval")
        found = experiment.verdict(one("sample_ratio")["chi_squared"], one("contamination")["rate"], lift["lift"], interval["low"], interval["high"])
        self.say(console.experiment(one("naive"), self.clean_table("experiment_by_segment").orderBy("segment").collect(), lift, interval, found))

    def weekly(self) -> DataFrame:
        return forecast.weekly_revenue(self.clean_table("subscriptions"), self.weeks, self.a.least_weekly)

    def forecast(self) -> None:
        weekly = self.weekly().persist()
        results = forecast.backtest(weekly)
        self.save(weekly_mrr=weekly, backtest_results=results, backtest_summary=forecast.score(results), forecast=forecast.forecast(weekly, results=results), bias_drift=forecast.bias_drift(results))
        best = forecast.winner(results).first()
        ahead = self.clean_table("forecast").where(F.col("model") == best["model"]).orderBy("horizon").collect()
        self.say(console.forecast(self.clean_table("backtest_summary").collect(), best, self.clean_table("bias_drift").orderBy("model").collect(), ahead))

    def export(self) -> None:
        panel, weekly = self.panel(), self.weekly()
        results = forecast.backtest(weekly)
        best = forecast.winner(results).first()
        movement = retention.retention_bridge(panel, 12, self.a.least_cohort)
        star_tables = {
            "dim_date": star.dim_date(self.spark, self.a.first, self.a.as_of), "dim_customer": star.dim_customer(self.clean_table("customers")), "dim_plan": star.dim_plan_of(self.clean_table("subscriptions")), "fact_mrr": star.fact_mrr(panel),
            "fact_movement": star.with_date_key(movement, "month"), "fact_forecast": star.fact_forecast(weekly, forecast.forecast(weekly, results=results), best["model"]),
            "fact_reconciliation_ledger": self.ledger(), "fact_reconciliation_monthly": star.with_date_key(self.bridge(), "month"),
        }
        for name, df in star_tables.items():
            tables.write_csv(df, self.a.out, name, single_file=name != "fact_mrr")

    def memo(self) -> None:
        panel, bad = self.panel().persist(), experiment.contaminated(self.arms())
        movement, weekly, outcomes = retention.retention_bridge(panel, 12, self.a.least_cohort), self.weekly().persist(), self.outcomes()
        results = forecast.backtest(weekly)
        found = report.gather(
            self.ledger(), reconcile.verdict(self.bridge()), reconcile.coverage(self.clean_table("invoices"), self.months), movement, retention.peak_and_latest(movement), retention.attribute_decline(movement),
            experiment.check_srm(self.arms()), experiment.check_contamination(self.arms()), experiment.stratified_lift(outcomes, bad), experiment.bootstrap(outcomes, bad), forecast.winner(results), forecast.forecast(weekly, results=results),
            retention.retention_by(panel, self.a.last, {"segment": self.clean_table("customers")}), retention.pause_curve(self.spark.read.parquet(f"{self.a.raw}/subscriptions.parquet")), forecast.bias_drift(results), experiment.naive_lift(outcomes),
            self.contract,
        )
        tables.write_text(report.render(found), f"{self.a.out}/memo.md")


STAGES = ("generate", "clean", "reconcile", "decompose", "experiment", "forecast", "export", "memo")


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=STAGES)
    for name, default in (("raw", "data/raw"), ("processed", "data/processed"), ("out", "data/out"), ("policy", None), ("first", "2024-01-01"), ("last", "2026-06-01"), ("before", "2026-01-01"), ("as-of", "2026-06-30")):
        p.add_argument(f"--{name}", default=default)
    for name, default in (("customers", 5000), ("seed", 11), ("least-cohort", 500), ("least-weekly", 100_000)):
        p.add_argument(f"--{name}", type=int, default=default)
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    getattr(Job(session(), args), args.stage)()


if __name__ == "__main__":
    main()
