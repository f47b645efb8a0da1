"""A memo in which every number comes from a query result, and says from which."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .contract import Contract
from .operators import experiment

# Tags of the memo, the operator that makes each number, and the test that guards it.
PROVENANCE = {
    "ledger": ("operators.reconcile.reconcile_ledger", "test_engine.py::test_ledger_conserves"),
    "bridge": ("operators.reconcile.reconcile_months", "test_engine.py::test_bridge_closes"),
    "coverage": ("operators.reconcile.coverage", "test_engine.py::test_coverage"),
    "retention": ("operators.retention.retention_bridge", "test_engine.py::test_bridge_identity"),
    "drivers": ("operators.retention.attribute_decline", "test_engine.py::test_attribution_golden"),
    "churn": ("operators.retention.retention_bridge", "test_engine.py::test_bridge_identity"),
    "segments": ("operators.retention.retention_by", "test_engine.py::test_cuts_add_up"),
    "pauses": ("operators.retention.pause_curve", "test_engine.py::test_generated_pauses_return_early"),
    "experiment": ("operators.experiment.stratified_lift", "test_engine.py::test_contamination_excluded"),
    "interval": ("operators.experiment.bootstrap", "test_engine.py::test_bootstrap_is_stable"),
    "forecast": ("operators.forecast.forecast", "test_engine.py::test_forecast_golden"),
    "models": ("operators.forecast.score", "test_engine.py::test_backtest_knows_no_future"),
    "bias": ("operators.forecast.bias_drift", "test_engine.py::test_forecast_golden"),
}


@dataclass(frozen=True)
class Findings:
    ledger: list[Row]
    worst_residual: float
    months: int
    outside: float
    peak: Row
    latest: Row
    drivers: list[Row]
    ratio: Row
    contamination: Row
    lift: Row
    interval: Row
    winner: Row
    forecast: list[Row]
    segments: list[Row]
    pauses: list[Row]
    bias: list[Row]
    naive: Row
    contract: Contract


def gather(ledger: DataFrame, verdict: DataFrame, coverage: DataFrame, movement: DataFrame, ends: DataFrame, drivers: DataFrame, ratio: DataFrame, contamination: DataFrame, lift: DataFrame, interval: DataFrame, winner: DataFrame, forecast: DataFrame, segments: DataFrame, pauses: DataFrame, bias: DataFrame, naive: DataFrame, contract: Contract) -> Findings:
    """Collect the small result tables, each once."""
    e, v, w = ends.first(), verdict.first(), winner.first()
    at = lambda m: movement.where(F.col("month") == m).first()
    outside = sum(float(r["dollars"]) for r in coverage.where("not inside").collect())
    ahead = forecast.where(F.col("model") == w["model"]).orderBy("horizon").collect()
    return Findings(ledger.orderBy("line_no").collect(), float(v["worst"] or 0), v["months"], outside, at(e["peak_month"]), at(e["latest_month"]), drivers.collect(), ratio.first(), contamination.first(), lift.first(), interval.first(), w, ahead, segments.orderBy("value").collect(), pauses.orderBy("months_away").collect(), bias.where(F.col("model") == w["model"]).collect(), naive.first(), contract)


def _pct(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f} %"


def render(f: Findings) -> str:
    up = f.latest["logo_churn_rate"] - f.peak["logo_churn_rate"]
    found = experiment.verdict(f.ratio["chi_squared"], f.contamination["rate"], f.lift["lift"], f.interval["low"], f.interval["high"])
    p = found["p_value"]
    grace = f.contract.pause_grace_days
    early = [r["running_share"] for r in f.pauses if 30.44 * r["months_away"] <= grace + 15]
    lines = ["# Revenue retention", "", "## Can the books be trusted?", ""]
    lines += [f"- {r['line']}: {r['rows']:,} rows, {float(r['dollars']):,.2f} [ledger]" for r in f.ledger]
    lines += [f"- largest monthly residual over {f.months} months: {f.worst_residual:.2f} [bridge]", f"- billed outside those months: {f.outside:,.2f} [coverage]", "", "## What happened to retention?", ""]
    lines += [f"- net retention went from {_pct(f.peak['nrr'])} ({f.peak['month']}) to {_pct(f.latest['nrr'])} ({f.latest['month']}) [retention]"]
    lines += [f"- revenue churn {_pct(f.peak['churn_rate'])} to {_pct(f.latest['churn_rate'])}; logo churn {_pct(f.peak['logo_churn_rate'])} to {_pct(f.latest['logo_churn_rate'])}, {'worse' if up > 0 else 'no worse'} [churn]"]
    lines += [f"- {r['driver']}: {_pct(r['nrr_impact'])} of net retention, {_pct(r['share'])} of the change [drivers]" for r in f.drivers]
    lines += [f"- {r['value']}: net retention {_pct(r['nrr'])}, {float(r['mrr_lost']):,.0f} lost [segments]" for r in f.segments]
    lines += [f"- of those who came back from a pause, {_pct(early[-1])} did so within {len(early)} months, which the grace of {grace} days stands for [pauses]"] * bool(early)
    lines += ["", "## Did the experiment work?", "", f"- arms of {f.ratio['control']:,} and {f.ratio['treatment']:,}, p = {p:.1e}: {'the split is off' if p < 0.01 else 'as intended'} [experiment]", f"- {f.contamination['contaminated']} customers in both arms, left out [experiment]", f"- read without checks it shows {_pct(f.naive['lift'])} [experiment]"]
    lines += [f"- lift {_pct(f.lift['lift'])}, interval {_pct(f.interval['low'])} to {_pct(f.interval['high'])}: {found['claim']} [interval]", "", "## What comes next?", ""]
    lines += [f"- {f.winner['model']} has the lowest recent error, {_pct(f.winner['mape'])} [models]"]
    lines += [f"- its errors at the far horizon went from {r['early_bias']:,.0f} to {r['late_bias']:,.0f}{': it used to be low and is now high, or the reverse' if r['sign_flipped'] else ''} [bias]" for r in f.bias]
    if f.forecast:
        z = f.forecast[-1]
        lines += [f"- week of {z['week']}: {z['forecast']:,.0f}, between {z['lower']:,.0f} and {z['upper']:,.0f} [forecast]"]
    largest = max(f.drivers, key=lambda r: abs(r["nrr_impact"] or 0), default=None)
    worst = min(f.segments, key=lambda r: 1.0 if r["nrr"] is None else r["nrr"], default=None)
    lines += ["", "## What to do", ""]
    lines += [f"- look at {largest['driver']} first: it moved net retention most [drivers]"] * (largest is not None)
    lines += [f"- begin with {worst['value']}, which keeps least [segments]"] * (worst is not None)
    lines += [f"- the experiment: {found['advice']} [interval]"]
    lines += ["", "## What these numbers cannot tell", ""]
    lines += ["- why customers left: billing data has no reasons, so drivers are arithmetic and not causes", "- whether unseen imbalance moved the experiment: strata mend what was recorded alone", f"- anything outside the policy: {', '.join(f.contract.out_of_scope) or 'nothing is listed'}"]
    lines += ["", "## Where the numbers come from", ""] + [f"- [{tag}] {made}, guarded by {test}" for tag, (made, test) in PROVENANCE.items()]
    return "\n".join(lines) + "\n"
