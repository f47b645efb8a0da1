"""The measurement policy as a validated, immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

DEFAULT = Path(__file__).with_name("policy.yaml")

# What a policy has to name.
PARAMETERS = ("pause_grace_days", "addons_count_as_mrr", "winback_window_days", "refund_attribution", "restate_history_on_correction", "currency")
METRICS = ("mrr", "arr", "addon_revenue", "logo_churn", "revenue_churn", "contraction", "expansion", "gross_revenue_retention", "net_revenue_retention")
METRIC_FIELDS = ("definition", "formula", "grain", "excludes", "depends_on")
RULING_FIELDS = ("id", "question", "ruling", "evidence", "rejected_alternatives", "cost_of_this_choice", "affects")
SECTIONS = ("version", "parameters", "metrics", "rulings")
REFUND_MONTHS = ("original_invoice_month", "issue_month")


class ContractViolation(Exception):
    """The policy is absent or incomplete; nothing may be computed under it."""


@dataclass(frozen=True)
class Contract:
    version: str
    parameters: dict[str, Any]
    metrics: dict[str, dict]
    rulings: dict[str, dict]
    components: dict[str, dict] = field(default_factory=dict)
    effective_date: str = ""
    owner: str = ""
    status: str = ""
    out_of_scope: tuple[str, ...] = ()

    @property
    def pause_grace_days(self) -> int:
        return int(self.parameters["pause_grace_days"])

    @property
    def winback_window_days(self) -> int:
        return int(self.parameters["winback_window_days"])

    @property
    def addons_count_as_mrr(self) -> bool:
        return bool(self.parameters["addons_count_as_mrr"])

    @property
    def refunds_to_original_month(self) -> bool:
        return self.parameters["refund_attribution"] == "original_invoice_month"

    @property
    def restate_history(self) -> bool:
        return bool(self.parameters["restate_history_on_correction"])

    def ruling(self, name: str) -> dict:
        if name not in self.rulings:
            raise ContractViolation(f"no ruling {name}")
        return self.rulings[name]

    def describe(self) -> str:
        head = [f"policy {self.version}, {self.status or 'without a status'}, in effect from {self.effective_date or 'an unstated day'}, owned by {self.owner or 'nobody'}"]
        head += [f"{len(self.metrics)} metrics, {len(self.rulings)} rulings"] + [f"  {k} = {v}" for k, v in self.parameters.items()]
        head += [line for k, r in self.rulings.items() for line in (f"  {k}: {r['question']}", f"      {r['ruling']}")]
        return "\n".join(head + [f"  not covered: {', '.join(self.out_of_scope)}"] * bool(self.out_of_scope))


def _absent(what: str, wanted, given) -> None:
    missing = [k for k in wanted if k not in given]
    if missing:
        raise ContractViolation(f"{what}: {', '.join(missing)} missing")


def validate(spec: Any) -> Contract:
    if not isinstance(spec, dict):
        raise ContractViolation("a policy is a mapping")
    _absent("policy", SECTIONS, spec)
    parameters, metrics, rulings = spec["parameters"], spec["metrics"], spec["rulings"]
    _absent("parameters", PARAMETERS, parameters)
    _absent("metrics", METRICS, metrics)
    if parameters["refund_attribution"] not in REFUND_MONTHS:
        raise ContractViolation(f"refund_attribution is one of {', '.join(REFUND_MONTHS)}")
    for name, metric in metrics.items():
        _absent(f"metric {name}", METRIC_FIELDS, metric)
        _absent(f"metric {name} depends on parameters", metric["depends_on"], parameters)
    for r in rulings:
        _absent(f"ruling {r.get('id', '?')}", RULING_FIELDS, r)
        _absent(f"ruling {r['id']} affects metrics", r["affects"], metrics)
        if not r["evidence"]:
            raise ContractViolation(f"ruling {r['id']} has no evidence")
    named = {r["id"]: r for r in rulings}
    if len(named) != len(rulings):
        raise ContractViolation("rulings share an id")
    components = dict(spec.get("components") or {})
    for name, component in components.items():
        _absent(f"component {name}", ("over", "formula"), component)
        if name in metrics:
            raise ContractViolation(f"{name} is both a component and a metric")
    about = {k: str(spec.get(k, "")) for k in ("effective_date", "owner", "status")}
    return Contract(str(spec["version"]), dict(parameters), dict(metrics), named, components, **about, out_of_scope=tuple(spec.get("out_of_scope") or ()))


def load(path: str | Path = DEFAULT) -> Contract:
    path = Path(path)
    if not path.is_file():
        raise ContractViolation(f"{path} not found")
    return validate(yaml.safe_load(path.read_text(encoding="utf-8")))
