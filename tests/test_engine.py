"""Operators by hand-made inputs, identities and policies; queries against SQL run apart."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import replace
from decimal import Decimal

import pytest
import yaml
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerwright import contract as policy
from ledgerwright import generator, report
from ledgerwright.functions.calendar import Grid, asof_expand
from ledgerwright.functions.money import parse_amount
from ledgerwright.operators import cleaning, experiment, forecast, reconcile, retention, star

from . import goldens

D = dt.date
C = policy.load()
SUBS = "subscription_id long, customer_id long, plan_tier string, mrr decimal(18,2), period_start date, period_end date, status string, is_correction boolean"


def with_parameter(**values) -> policy.Contract:
    return replace(C, parameters=C.parameters | values)


def subs(spark, *rows):
    full = [(i, c, p, Decimal(str(m)), a, b, s, k) for i, (c, p, m, a, b, s, k) in enumerate(rows)]
    return spark.createDataFrame(full, SUBS)


# policy


def test_policy_is_whole():
    assert C.pause_grace_days == 60 and not C.addons_count_as_mrr and C.refunds_to_original_month and C.restate_history and C.winback_window_days == 90
    assert C.ruling("R1")["affects"] and "R6" in C.describe()
    assert C.owner and C.status and C.effective_date and C.out_of_scope and all(x in C.describe() for x in (C.owner, C.status, "9 metrics", C.ruling("R1")["question"], *C.out_of_scope))


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s.pop("rulings"),
        lambda s: s["parameters"].pop("currency"),
        lambda s: s["metrics"].pop("arr"),
        lambda s: s["metrics"]["mrr"].pop("grain"),
        lambda s: s["metrics"]["mrr"]["depends_on"].append("nothing"),
        lambda s: s["rulings"][0].pop("evidence"),
        lambda s: s["rulings"][0]["affects"].append("nothing"),
        lambda s: s["rulings"].append(s["rulings"][0]),
        lambda s: s["parameters"].update(refund_attribution="whenever"),
    ],
)
def test_policy_mutations_fail(change):
    spec = yaml.safe_load(policy.DEFAULT.read_text())
    change(spec)
    with pytest.raises(policy.ContractViolation):
        policy.validate(spec)


def test_policy_absent(tmp_path):
    with pytest.raises(policy.ContractViolation):
        policy.load(tmp_path / "none.yaml")
    with pytest.raises(policy.ContractViolation):
        C.ruling("R99")


# cleaning


def test_amounts(spark):
    rows = spark.createDataFrame([(k,) for k in goldens.AMOUNTS], "t string").select("t", parse_amount(F.col("t")).cast("double").alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == goldens.AMOUNTS


def test_bad_amount_is_an_error(spark):
    for text in ("12x", "(500.00", "5(0", "1)2", "500.00)", "()", "", "((5))", "5$x", "1.999", "(0.005)"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(text,)], "t string").select(parse_amount(F.col("t"))).collect()


def test_duplicates_conserve(spark):
    rows = [("b", 1, 1, "2024-01-01", "5", "paid"), ("a", 1, 1, "2024-01-01", "$5.00", "paid"), ("c", 1, 1, "2024-01-02", "5", "paid")]
    inv = spark.createDataFrame(rows, "invoice_id string, customer_id long, subscription_id long, issued_date string, amount string, status string")
    step = cleaning.remove_duplicates(cleaning.parse_amounts(inv, ("amount",)).kept, [F.col("invoice_id")])
    assert {r["invoice_id"] for r in step.kept.collect()} == {"a", "c"} and [r["invoice_id"] for r in step.removed.collect()] == ["b"]
    assert step.audit.first()["dollars"] == 5


def test_refunds_follow_policy(spark):
    inv = spark.createDataFrame([("i", D(2024, 1, 5), None, 9.0), ("r", D(2024, 2, 9), "i", -9.0), ("s", D(2024, 3, 1), "gone", -1.0)], "invoice_id string, issued_date date, reverses_invoice_id string, amount double")
    day = lambda c: {r["invoice_id"]: r["effective_date"] for r in cleaning.attribute_refunds(inv, c).kept.collect()}
    assert day(C) == {"i": D(2024, 1, 5), "r": D(2024, 1, 5), "s": D(2024, 3, 1)}
    assert day(with_parameter(refund_attribution="issue_month"))["r"] == D(2024, 2, 9)


def test_corrections_follow_policy(spark):
    s = subs(spark, (1, "Growth", 100, D(2024, 1, 1), None, "active", False), (1, "Growth", 80, D(2024, 1, 1), None, "active", True), (2, "Growth", 50, D(2024, 1, 1), None, "active", False))
    total = lambda c: float(cleaning.apply_corrections(s, c).kept.agg(F.sum("mrr")).first()[0])
    assert total(C) == 130 and total(with_parameter(restate_history_on_correction=False)) == 150


def test_pauses_and_grace(spark):
    s = subs(
        spark,
        (1, "Growth", 10, D(2024, 1, 1), D(2024, 2, 1), "paused", False), (1, "Growth", 10, D(2024, 4, 1), None, "active", False),
        (2, "Growth", 10, D(2024, 1, 1), D(2024, 2, 1), "paused", False), (2, "Growth", 10, D(2024, 4, 2), None, "active", False),
        (3, "Growth", 10, D(2024, 1, 1), D(2024, 2, 1), "paused", False), (4, "Growth", 10, D(2024, 1, 1), D(2024, 2, 1), "paused", False), (4, "Growth", 10, D(2024, 2, 1), None, "active", False),
    )
    got = lambda c: {r["customer_id"]: r["status"] for r in cleaning.resolve_pauses(s, c).kept.where("was_paused").collect()}
    assert got(C) == {1: "paused_returned", 2: "churned", 3: "churned", 4: "churned"}
    assert got(with_parameter(pause_grace_days=1095))[2] == "paused_returned"


def test_segments_and_absent(spark):
    c = spark.createDataFrame([(1, " smb "), (2, "ENT"), (3, None), (4, "Other"), (5, "Mid Market")], "customer_id long, segment string").withColumns({"industry": F.lit(None).cast("string"), "region": F.lit("x")})
    step = cleaning.standardise_customers(c)
    assert [r["segment"] for r in step.kept.orderBy("customer_id").collect()] == ["SMB", "Enterprise", "Unknown", "Other", "Mid-Market"]
    assert {r["step"]: r["rows_affected"] for r in step.audit.collect()} == {"label absent attributes": 6, "standardise spelling": 0}
    twice = spark.createDataFrame([(1, " smb "), (2, "SMB"), (3, "S.M.B.")], "customer_id long, segment string").withColumns({"industry": F.lit("i"), "region": F.lit("x")})
    audit = {r["step"]: r for r in cleaning.standardise_customers(twice).audit.collect()}
    assert audit["standardise spelling"]["rows_affected"] == 2 and audit["standardise spelling"]["detail"]


# as-of join, retention


def test_asof_expand_is_the_range_join(spark):
    import random

    r = random.Random(4)
    rows = [(i, D(2023, 11, 1) + dt.timedelta(r.randrange(500)), r.choice([None, r.randrange(300)])) for i in range(400)]
    periods = spark.createDataFrame([(i, a, None if b is None else a + dt.timedelta(b)) for i, a, b in rows], "id long, period_start date, period_end date")
    for step in ("month", "week", "day"):
        grid = Grid("2024-01-01", "2024-12-01", step, "2024-12-20")
        fast = asof_expand(periods, grid, "p").select("id", "p")
        slow = periods.join(grid.points(spark, "p"), (F.col("period_start") <= F.col("p")) & (F.coalesce("period_end", F.lit("2024-12-20").cast("date")) > F.col("p"))).select("id", "p")
        assert fast.exceptAll(slow).isEmpty() and slow.exceptAll(fast).isEmpty() and not fast.isEmpty()


def panel(spark):
    s = subs(
        spark,
        (1, "Growth", 100, D(2024, 1, 1), None, "active", False),
        (2, "Starter", 50, D(2024, 1, 1), D(2024, 6, 1), "churned", False),
        (3, "Growth", 80, D(2024, 1, 1), D(2024, 7, 1), "active", False), (3, "Starter", 30, D(2024, 7, 1), None, "downgraded", False),
        (4, "Growth", 10, D(2024, 1, 1), D(2024, 3, 1), "active", False), (4, "Growth", 25, D(2024, 3, 1), None, "expanded", False),
        (5, "Growth", 500, D(2024, 9, 1), None, "active", False),
    )
    return retention.build_panel(s, Grid("2024-01-01", "2025-02-01", "month", "2025-02-20"))


def test_bridge_identity(spark):
    rows = {r["month"]: r for r in retention.retention_bridge(panel(spark)).collect()}
    r = rows[D(2025, 1, 1)]
    assert [float(r[c]) for c in ("starting_mrr", "churned_mrr", "contraction_mrr", "expansion_mrr", "ending_mrr")] == [240, -50, -50, 15, 155]
    assert r["cohort_customers"] == 4 and r["logo_churn_rate"] == 0.25 and r["churn_rate"] == 50 / 240
    for r in rows.values():
        assert r["starting_mrr"] + r["churned_mrr"] + r["contraction_mrr"] + r["expansion_mrr"] == r["ending_mrr"]
        assert r["grr"] <= min(1, r["nrr"])
    assert retention.retention_bridge(panel(spark), 12, least_customers=9).isEmpty()


def test_cuts_add_up(spark):
    who = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, None)], "customer_id long, segment string")
    rows = retention.retention_by(panel(spark), "2025-01-01", {"segment": who, "plan_tier": None}).collect()
    by = {(r["dimension"], r["value"]): float(r["starting_mrr"]) for r in rows}
    assert by == {("segment", "A"): 150, ("segment", "B"): 80, ("plan_tier", "Growth"): 190, ("plan_tier", "Starter"): 50}


def test_attribution_golden(spark):
    (m1, n1, c1, k1, e1, *_), (m2, n2, c2, *_) = goldens.PEAK, goldens.LATEST
    # the latest month's rates follow from the published shares
    delta = n2 - n1
    k2, e2 = k1 - goldens.SHARES["contraction"] * delta, e1 + goldens.SHARES["expansion"] * delta
    rows = spark.createDataFrame([(D.fromisoformat(m1), n1, c1, k1, e1), (D.fromisoformat(m2), n2, c2, k2, e2)], "month date, nrr double, churn_rate double, contraction_rate double, expansion_rate double")
    got = {r["driver"]: r["share"] for r in retention.attribute_decline(rows).collect()}
    for driver, share in goldens.SHARES.items():
        assert got[driver] == pytest.approx(share, abs=1e-3)


def test_inflections(spark):
    m = spark.createDataFrame([(D(2024, i + 1, 1), v) for i, v in enumerate((0.1, 0.1, 0.1, 0.3, 0.1))], "month date, churn_rate double")
    rows = retention.find_inflections(m, "churn_rate", 0.4, events={"2024-04": "price rise"}).collect()
    assert [(r["month"].month, r["event"]) for r in rows] == [(4, "price rise")]


# reconciliation


def test_bridge_closes(spark):
    s = subs(spark, (1, "Growth", 100, D(2024, 1, 1), None, "active", False), (2, "Growth", 50, D(2024, 1, 1), D(2024, 2, 1), "active", False))
    rows = [(1, D(2024, 1, 1), 100, 5, None), (2, D(2024, 1, 3), 50, 0, None), (2, D(2024, 2, 1), 50, 0, None), (1, D(2024, 1, 9), -100, -5, "x")]
    inv = spark.createDataFrame([(i, d, Decimal(b), Decimal(a), x, Decimal(a + b)) for i, d, b, a, x in rows], "subscription_id long, effective_date date, base_amount decimal(18,2), addon_amount decimal(18,2), reverses_invoice_id string, amount decimal(18,2)")
    # ids of the helper: the customer's first row
    inv = inv.withColumn("subscription_id", F.col("subscription_id") - 1)
    grid = Grid("2024-01-01", "2024-02-01", "month", "2024-03-01")
    got = {r["month"].month: r for r in reconcile.reconcile_months(s, inv, grid, C).collect()}
    assert [float(got[1][c]) for c in ("contracted_mrr", "less_not_invoiced", "plus_invoiced_not_active", "plus_refunds_base", "billed_base", "plus_addons", "residual")] == [150, 0, 0, -100, 50, 0, 0]
    assert [float(got[2][c]) for c in ("contracted_mrr", "less_not_invoiced", "plus_invoiced_not_active", "billed_base", "residual")] == [100, -100, 50, 50, 0]
    folded = reconcile.reconcile_months(s, inv, grid, with_parameter(addons_count_as_mrr=True)).agg(F.sum("plus_addons")).first()[0]
    assert folded == 0
    assert reconcile.verdict(reconcile.reconcile_months(s, inv, grid, C)).first()["failures"] == 0


def test_coverage(spark):
    inv = spark.createDataFrame([(D(2024, 1, 5), Decimal(1)), (D(2025, 1, 5), Decimal(2)), (None, Decimal(4))], "effective_date date, amount decimal(18,2)")
    got = {r["inside"]: float(r["dollars"]) for r in reconcile.coverage(inv, Grid("2024-01-01", "2024-06-01")).collect()}
    assert got == {True: 1, False: 6}


# experiment


def outcomes(spark, n=200):
    rows = [(i, "treatment" if i % 2 else "control", D(2024, 1, 1), "A" if i % 4 < 2 else "B", Decimal(100), Decimal(90 + 10 * (i % 2))) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id long, variant string, assigned_date date, segment string, pre decimal(28,2), post decimal(28,2)")


def test_sample_ratio(spark):
    a = spark.createDataFrame([(i, "control" if i < 60 else "treatment", D(2024, 1, 1)) for i in range(100)], "customer_id long, variant string, assigned_date date")
    assert experiment.check_srm(a).first()["chi_squared"] == 4.0
    assert experiment.srm_p_value(4.0) == pytest.approx(0.0455, abs=1e-4)


def test_contamination_excluded(spark):
    o = outcomes(spark)
    both = o.where("customer_id < 10").withColumn("variant", F.when(F.col("variant") == "control", "treatment").otherwise("control")).withColumn("assigned_date", F.lit("2024-01-10").cast("date"))
    whole = o.unionByName(both)
    bad = experiment.contaminated(whole)
    assert bad.count() == 10 and experiment.check_contamination(whole).first()["contaminated"] == 10
    assert experiment.stratified_lift(whole, bad).first()["lift"] == pytest.approx(0.1)
    assert experiment.by_segment(o.limit(20)).isEmpty() and experiment.stratified_lift(o.limit(20)).first()["lift"] is None


def test_bootstrap_is_stable(spark):
    o = outcomes(spark).withColumn("post", F.when(F.col("customer_id") % 7 == 0, F.lit(0)).otherwise(F.col("post")).cast("decimal(28,2)"))
    a, b = experiment.bootstrap(o).first(), experiment.bootstrap(o.repartition(7)).first()
    assert a["replicates"] == 600 and a["low"] < experiment.stratified_lift(o).first()["lift"] < a["high"]
    assert math.isclose(a["low"], b["low"], abs_tol=1e-9) and math.isclose(a["high"], b["high"], abs_tol=1e-9)


# forecast


def series(spark, values):
    rows = [(D(2023, 1, 1) + dt.timedelta(7 * i), Decimal(str(v))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "week date, mrr decimal(28,2)")


def run_model(spark, name, values, h):
    plan = forecast.Plan(horizon=h)
    return spark.range(1).select(forecast.MODELS[name](F.array(*map(F.lit, values)), plan).alias("x")).first()["x"]


def test_models_by_hand(spark):
    for name, (x, h, want) in (("naive", goldens.NAIVE), ("drift", goldens.DRIFT)):
        assert run_model(spark, name, x, h) == pytest.approx(want)
    x = [float(v) for v in range(100, 180, 10)]
    damped, drift = run_model(spark, "damped_trend", x, 20), run_model(spark, "drift", x, 20)
    steps = [b - a for a, b in zip(damped, damped[1:])]
    assert damped[-1] < drift[-1] and all(b < a for a, b in zip(steps, steps[1:]))
    level, trend = x[0], x[1] - x[0]
    for v in x[1:]:
        new = 0.3 * v + 0.7 * (level + 0.85 * trend)
        level, trend = new, 0.1 * (new - level) + 0.9 * 0.85 * trend
    assert damped[0] == pytest.approx(level + trend * 0.85)


def test_backtest_knows_no_future(spark):
    values = [1000 + 10 * i for i in range(90)]
    a = forecast.backtest(series(spark, values))
    b = forecast.backtest(series(spark, values[:60] + [1] * 30))
    first = lambda d: sorted((r["model"], r["horizon"], r["predicted"]) for r in d.where("origin <= 60").collect())
    assert first(a) == first(b) and a.count() == 7 * 3 * 13
    assert forecast.backtest(series(spark, values[:40])).isEmpty()


def test_forecast_golden(spark):
    s = series(spark, [1000 * 1.01**i for i in range(100)])
    rows = forecast.forecast(s).where("model = 'drift'").orderBy("horizon").collect()
    assert len(rows) == 13 and rows[0]["week"] == D(2023, 1, 1) + dt.timedelta(700)
    assert all(r["lower"] <= r["forecast"] <= r["upper"] and r["forecast"] > r["raw_forecast"] for r in rows)
    assert forecast.winner(forecast.backtest(s)).first()["model"] in forecast.MODELS
    flips = forecast.bias_drift(forecast.backtest(s)).collect()
    assert {r["model"] for r in flips} == set(forecast.MODELS)


# star


def test_star(spark):
    days = star.dim_date(spark, "2024-01-01", "2024-12-31")
    assert days.count() == 366 == days.select("date_key").distinct().count()
    r = days.where("date_key = 20240303").first()
    assert r["week_start"] == D(2024, 2, 26) and r["quarter"] == "Q1" and r["month_name"] == "Mar"
    fact = star.fact_mrr(panel(spark))
    got = star.revenue_by(fact, None, ["plan_tier"]).agg(F.sum("total_mrr")).first()[0]
    assert float(got) == 655  # the last date with facts, not the last day of a calendar
    assert star.dim_plan(spark).count() == 3


# whole pipeline on generated data


@pytest.fixture(scope="module")
def made(spark):
    tables, manifest = generator.generate(spark, generator.Shape(customers=250))
    tables["invoices"] = tables["invoices"].withColumn("issued_date", F.col("issued_date").cast("date"))
    return {k: v.persist() for k, v in tables.items()}, {r["defect"]: r["rows_affected"] for r in manifest.collect()}


def test_generator_is_reproducible(spark, made):
    again, _ = generator.generate(spark, generator.Shape(customers=250))
    assert again["subscriptions"].exceptAll(made[0]["subscriptions"]).isEmpty()
    other, _ = generator.generate(spark, generator.Shape(customers=250, seed=12))
    assert not other["subscriptions"].exceptAll(made[0]["subscriptions"]).isEmpty()
    assert all(n > 0 for n in made[1].values())


def test_ledger_conserves(spark, made):
    tables, defects = made
    done, audit = cleaning.clean(tables, C, [F.col("invoice_id")])
    raw = cleaning.parse_amounts(tables["invoices"]).kept
    lines = reconcile.reconcile_ledger(raw, done["invoices"], done["quarantine_duplicate_invoices"], done["quarantine_orphan_invoices"])
    last = lines.where("line_no = 5").first()
    assert last["rows"] == 0 and last["dollars"] == 0
    steps = {r["step"]: r["rows_affected"] for r in audit.collect()}
    assert steps["parse amounts"] == defects["amounts as text"] and steps["quarantine orphans"] == defects["orphans"]
    assert steps["remove duplicates"] == defects["duplicates"] > defects["duplicates with a new id"] > 0 and steps["flag time zone drift"] == defects["drift over midnight"]
    months = reconcile.reconcile_months(done["subscriptions"], done["invoices"], Grid("2024-02-01", "2026-06-01", "month", "2026-06-30"), C)
    assert reconcile.verdict(months).first()["failures"] == 0


def test_planted_causes():
    shape = generator.Shape()
    before, after = D(2025, 6, 1), D(2025, 12, 1)
    leave = lambda day, heavy: generator.hazards(shape, day, "Starter", "SMB", heavy)[0]
    assert leave(after, True) > 2 * leave(before, True) and leave(after, False) == leave(before, False)
    down = lambda day, segment: generator.hazards(shape, day, "Growth", segment, False)[1]
    assert down(after, "SMB") > down(after, "Enterprise") > 5 * down(before, "SMB")
    up = lambda day: generator.hazards(shape, day, "Enterprise", "Enterprise", False)[2]
    assert up(after) < up(before) / 4 and generator.hazards(shape, after, "Starter", "SMB", True)[1] == 0


def test_generated_pauses_return_early(spark, made):
    shape = generator.Shape(customers=3000)
    curve = retention.pause_curve(generator.subscriptions(spark, shape, generator.customers(spark, shape))).collect()
    assert sum(r["returns"] for r in curve) > 100 and max(r["running_share"] for r in curve if r["months_away"] <= 2) > 0.7
    assert made[1]["cancellations left as pauses"] > 0


def test_usage_covers_whole_periods(spark, made):
    subs = made[0]["subscriptions"].where("not is_correction")
    days = subs.select(F.sum(F.datediff(F.coalesce("period_end", F.lit("2026-06-30").cast("date")), "period_start") + 1)).first()[0]
    usage = made[0]["usage_events"]
    assert usage.count() == days and usage.agg(F.max("event_date")).first()[0].date() == D(2026, 6, 30)


def test_experiment_verdict(spark):
    o = outcomes(spark)
    assert experiment.naive_lift(o).first()["lift"] == pytest.approx(0.1)
    wide = experiment.verdict(20.0, 0.02, -0.02, -0.1, 0.06)
    assert not wide["split_as_meant"] and not wide["apart_from_zero"] and "no claim" in wide["claim"] and "again" in wide["advice"]
    assert experiment.verdict(0.1, 0.0, 0.05, 0.01, 0.09)["advice"] == "act on it"
    assert experiment.verdict(None, None, None, None, None)["apart_from_zero"] is False


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 2, 1), "x", "y", "z")], "customer_id long, period_start date, period_end date, __day string, __START string, __lo string")
    out = cleaning.next_start(rows)
    assert out.first()["__day"] == "x" and out.first()["__START"] == "y" and set(out.columns) == {*rows.columns, "next_start"}
    spread = asof_expand(rows, Grid("2024-01-01", "2024-06-01"), "month")
    assert spread.first()["__lo"] == "z" and set(spread.columns) == {*rows.columns, "month"}


def test_stages_end_to_end(spark, tmp_path, capsys):
    """Every stage of the command line over files, on a small made-up company."""
    from ledgerwright import cli
    from ledgerwright.sources import tables

    where = [f"--{k}={tmp_path / k}" for k in ("raw", "processed", "out")] + ["--customers=300", "--least-cohort=20", "--least-weekly=1000"]
    for stage in cli.STAGES:
        cli.main([stage, *where])
    said = capsys.readouterr().out
    for part in ("From raw to clean ledger", "every month closes", "Retention bridge", "Verdict", "lowest recent error", "standardise spelling"):
        assert part in said, part
    memo = (tmp_path / "out" / "memo.md").read_text()
    assert all(f"[{tag}]" in memo for tag in report.PROVENANCE) and len(report.PROVENANCE) >= 12
    assert "What to do" in memo and "cannot tell" in memo
    ledger = tables.read_parquet(spark, str(tmp_path / "processed"), "reconciliation_ledger")
    assert ledger.where("line_no = 5").first()["rows"] == 0
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "dim_plan.csv"))
    assert back.count() == 3 and spark.read.option("header", True).csv(str(tmp_path / "out" / "fact_mrr.csv")).count() > 100


def test_memo_follows_its_data(spark):
    tags = set(report.PROVENANCE)
    source = (policy.DEFAULT.parent.parent / "tests" / "test_engine.py").read_text()
    assert all(f"def {test.split('::')[1]}(" in source for _, test in report.PROVENANCE.values())
    assert {"ledger", "retention", "forecast"} <= tags


def test_usage_stream(spark, tmp_path):
    from ledgerwright.streaming.usage import daily_usage

    rows = [(i % 3, dt.datetime(2024, 1, 1 + i % 2, 3)) for i in range(30)]
    spark.createDataFrame(rows, "customer_id long, event_ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("customer_id long, event_ts timestamp_ntz").parquet(str(tmp_path / "in"))
    q = daily_usage(source).writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("usage").agg(F.sum("events")).first()[0] == 30
