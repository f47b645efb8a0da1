"""Plain-text reports over small, collected results: bridges, bars and verdicts."""

from __future__ import annotations

from collections.abc import Iterable

WIDTH = 40


def money(x) -> str:
    return f"{float(x):,.2f}"


def percent(x) -> str:
    return "n/a" if x is None else f"{100 * x:.1f} %"


def heading(text: str) -> list[str]:
    return ["", text, "=" * len(text)]


def bars(rows: Iterable[tuple[str, float | None]], show=percent) -> list[str]:
    """One bar a row, as long as the value's share of the largest."""
    rows = [(str(name), value) for name, value in rows]
    most = max((abs(v) for _, v in rows if v), default=0) or 1
    wide = max((len(n) for n, _ in rows), default=0)
    return [f"  {n:<{wide}}  {show(v):>14}  {'#' * round(WIDTH * abs(v or 0) / most)}" for n, v in rows]


def bridge(rows: Iterable[tuple[str, object]], show=money) -> list[str]:
    """Lines of a sum, one under the other, the last one ruled off."""
    lines = [(str(name), show(value)) for name, value in rows]
    wide, far = max((len(n) for n, _ in lines), default=0), max((len(v) for _, v in lines), default=0)
    out = [f"  {n:<{wide}}  {v:>{far}}" for n, v in lines]
    return out[:-1] + [f"  {'-' * (wide + far + 2)}", out[-1]] if out else []


def ledger(rows, verdict, coverage) -> list[str]:
    out = heading("From raw to clean ledger") + bridge((r["line"], r["dollars"]) for r in rows)
    out += heading("Contracted against billed, month by month")
    worst = verdict["worst"]
    closes = not verdict["failures"]
    out.append(f"  {verdict['months']} months, largest residual {'n/a' if worst is None else money(worst)}: {'every month closes' if closes else str(verdict['failures']) + ' months do not close'}")
    return out + [f"  {'inside' if r['inside'] else 'outside'} these months: {r['rows']:,} rows, {money(r['dollars'])}" for r in coverage]


def retention(peak, latest, drivers, cuts) -> list[str]:
    if latest is None:
        return heading("Retention") + ["  no month has a cohort large enough"]
    out = heading(f"Retention bridge of {latest['month']}")
    out += bridge((name, latest[c]) for name, c in (("starting", "starting_mrr"), ("churned", "churned_mrr"), ("contraction", "contraction_mrr"), ("expansion", "expansion_mrr"), ("ending", "ending_mrr")))
    out.append(f"  net retention {percent(latest['nrr'])}, after {percent(peak['nrr'])} in {peak['month']}")
    out += heading("What moved it") + bars((r["driver"], r["nrr_impact"]) for r in drivers)
    return out + heading("By group") + bars((f"{r['dimension']}: {r['value']}", r["nrr"]) for r in cuts)


def experiment(naive, segments, lift, interval, verdict) -> list[str]:
    out = heading("Experiment") + [f"  as read without checks: {percent(naive['lift'])}", f"  split p = {verdict['p_value']:.1e}: {'as meant' if verdict['split_as_meant'] else 'off'}"]
    out += bars((r["segment"], r["lift"]) for r in segments)
    out.append(f"  corrected: {percent(lift['lift'])}, between {percent(interval['low'])} and {percent(interval['high'])}")
    return out + heading("Verdict") + [f"  {verdict['claim']}", f"  {verdict['advice']}"]


def forecast(scores, winner, bias, ahead) -> list[str]:
    out = heading("Backtest, mean error") + bars(sorted((r["model"], r["mape"]) for r in scores))
    out += [f"  {r['model']}: errors at the far horizon from {r['early_bias']:,.0f} to {r['late_bias']:,.0f}{', the sign has turned' if r['sign_flipped'] else ''}" for r in bias]
    out.append(f"  lowest recent error: {winner['model']}, {percent(winner['mape'])}")
    return out + heading("Weeks ahead") + [f"  {r['week']}  {r['forecast']:,.0f}  [{r['lower']:,.0f}, {r['upper']:,.0f}]" for r in ahead]
