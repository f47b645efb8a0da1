"""The policy's metrics as columns: formulas are Spark SQL over named tables, components and other metrics.

The policy says how a number is made and this module makes it; nothing else has to be changed when a formula is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, ContractViolation
from .retention import cohort_changes

# Tables that formulas are over, a row a customer and month (or charge), and what a formula may call.
TABLES = {
    "panel": "month date, customer_id string, amount decimal(28,2)",
    "charges": "month date, addon_amount decimal(18,2)",
    "changes": "month date, customer_id string, was decimal(28,2), now decimal(28,2)",
}
FUNCTIONS = frozenset(("abs", "avg", "coalesce", "count", "count_if", "double", "greatest", "least", "max", "min", "nullif", "sum"))
WORDS = frozenset(("and", "between", "case", "distinct", "else", "end", "false", "in", "is", "not", "null", "or", "then", "true", "when"))
_NAME = re.compile(r"[A-Za-z_]\w*(\s*\()?")


@dataclass(frozen=True)
class Metric:
    name: str
    over: str
    sql: str  # over the table's columns alone
    needs: tuple[str, ...]  # components and metrics that it is made of, directly or not


def _columns(over: str) -> set[str]:
    return {f.split()[0] for f in TABLES[over].split(", ")}


def compile_metrics(contract: Contract) -> dict[str, Metric]:
    """Every component and metric of the policy with its formula down to columns. Unknown names, cycles, formulas over
    more than one table and names that a column has are violations of the policy."""
    specs = {**contract.components, **contract.metrics}
    done: dict[str, Metric] = {}

    def visit(name: str, path: tuple[str, ...]) -> Metric:
        if name in path:
            raise ContractViolation(f"metrics go round in a circle: {' -> '.join((*path, name))}")
        if name in done:
            return done[name]
        spec, over, needs = specs[name], specs[name].get("over"), []
        if over is not None and over not in TABLES:
            raise ContractViolation(f"metric {name} is over {over}, which is none of {', '.join(TABLES)}")

        def put(match: re.Match) -> str:
            nonlocal over
            word = match.group().rstrip("( \t\n")
            if match.group(1):
                if word.lower() not in FUNCTIONS:
                    raise ContractViolation(f"metric {name} calls {word}, which no formula may")
                return match.group()
            if word.lower() in WORDS:
                return word
            if over is not None and word in _columns(over):
                return word
            if word in contract.parameters:
                value = contract.parameters[word]
                return str(value).lower() if isinstance(value, (bool, int, float)) else f"'{value}'"
            if word not in specs:
                raise ContractViolation(f"metric {name} uses {word}, which is no column, parameter or metric")
            other = visit(word, (*path, name))
            if over is None:
                over = other.over
            if other.over != over:
                raise ContractViolation(f"metric {name} is over {over} and {other.over}")
            needs.extend((word, *other.needs))
            return f"({other.sql})"

        text = str(spec["formula"])
        if "'" in text or '"' in text or "`" in text or ";" in text:
            raise ContractViolation(f"metric {name}: a formula has no quotes")
        sql = _NAME.sub(put, text)
        if over is None:
            raise ContractViolation(f"metric {name} is over no table")
        if name in _columns(over):
            raise ContractViolation(f"metric {name} has the name of a column")
        done[name] = Metric(name, over, sql, tuple(dict.fromkeys(needs)))
        return done[name]

    for name in specs:
        visit(name, ())
    return done


def check(spark: SparkSession, contract: Contract) -> dict[str, Metric]:
    """compile_metrics(), and Spark's own analysis of each formula: that it is an aggregate, and of numbers."""
    made = compile_metrics(contract)
    for m in made.values():
        try:
            kind = spark.createDataFrame([], TABLES[m.over]).groupBy("month").agg(_column(m)).schema[m.name].dataType
        except AnalysisException as e:
            raise ContractViolation(f"metric {m.name}: {e}") from e
        if kind.typeName() != "double":
            raise ContractViolation(f"metric {m.name} is no number")
    return made


def _column(m: Metric) -> Column:
    return F.expr(f"cast({m.sql} as double)").alias(m.name)


def tables(panel: DataFrame, invoices: DataFrame, lag_months: int = 12) -> dict[str, DataFrame]:
    """What formulas are over: the panel, charges of the clean ledger by the month they count in, and cohorts' changes."""
    changes = cohort_changes(panel, lag_months).where("was is not null").select("month", "customer_id", "was", F.coalesce("is", F.lit(0)).cast("decimal(28,2)").alias("now"))
    return {
        "panel": panel.select("month", "customer_id", F.col("mrr").alias("amount")),
        "charges": invoices.select(F.trunc("effective_date", "MM").alias("month"), "addon_amount"),
        "changes": changes,
    }


def by_month(contract: Contract, given: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """month and the policy's metrics (all, or those named), of months in which the panel has customers.

    Metrics over one table are one aggregate; the tables' results, a row a month, are joined. A month that a table
    lacks has null for what is over it, and so has a quotient by 0.
    """
    made = compile_metrics(contract)
    names = list(contract.metrics) if names is None else names
    parts = []
    for over in sorted(TABLES, key=lambda t: t != "panel"):  # the panel's months, with what is over it, come first
        own = [_column(made[n]) for n in names if made[n].over == over]
        if own or over == "panel":
            parts.append(given[over].groupBy("month").agg(*own) if own else given[over].select("month").distinct())
    return reduce(lambda a, b: a.join(b, "month", "left"), parts).select("month", *names)


#: The policy's metrics and the columns of the retention bridge that say the same.
SAME = {"logo_churn": "logo_churn_rate", "revenue_churn": "churn_rate", "contraction": "contraction_rate", "expansion": "expansion_rate", "gross_revenue_retention": "grr", "net_revenue_retention": "nrr"}


def disagreements(metrics: DataFrame, movement: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """month, metric, policy, bridge: where the policy's formulas and the retention bridge differ."""
    both = movement.join(metrics, "month")
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("policy"), F.col(c).cast("double").alias("bridge")) for m, c in SAME.items()))
    rows = both.select("month", F.inline(pairs))
    same = (F.col("policy").isNull() & F.col("bridge").isNull()) | F.coalesce(F.abs(F.col("policy") - F.col("bridge")) <= tolerance, F.lit(False))
    return rows.where(~same)

