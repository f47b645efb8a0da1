"""Weekly revenue, three forecasts, their walk-forward errors, and intervals from these.

A series has a row a week, so it is one array; its models are array expressions, and every origin of the
backtest is a row that holds the prefix it may know.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import Grid, asof_sums


@dataclass(frozen=True)
class Plan:
    horizon: int = 13
    least_history: int = 52
    step: int = 4
    alpha: float = 0.3
    beta: float = 0.1
    phi: float = 0.85


def weekly_revenue(subscriptions: DataFrame, grid: Grid, least: float = 0.0) -> DataFrame:
    """week, mrr, subscriptions: revenue live on each Sunday, of weeks above ``least``; weeks without any are 0."""
    return _live(subscriptions, grid, "week").where(F.col("mrr") > least)


def daily_revenue(subscriptions: DataFrame, grid: Grid, by: list[str] | None = None) -> DataFrame:
    """day, what it is cut by, mrr and subscriptions live on each day; by key from its first day on."""
    return _live(subscriptions, grid, "day", by)


def _live(subscriptions: DataFrame, grid: Grid, name: str, by: list[str] | None = None) -> DataFrame:
    sums = asof_sums(subscriptions, grid, name, {"mrr": F.col("mrr"), "subscriptions": F.lit(1).cast("bigint")}, by)
    return sums.withColumns({"mrr": F.coalesce("mrr", F.lit(0)).cast("decimal(28,2)"), "subscriptions": F.col("subscriptions").cast("bigint")})


def growth(series: DataFrame) -> DataFrame:
    """Growth over thirteen weeks as of the last week, a quarter before, and a year before."""
    n = series.withColumn("k", F.row_number().over(Window.orderBy(F.desc("week"))))  # a row a week
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("mrr"))).cast("double")
    pairs = (("latest", 1, 14), ("quarter_before", 14, 27), ("year_before", 53, 66))
    return n.agg(*(F.when(at(b) != 0, at(a) / at(b) - 1).alias(name) for name, a, b in pairs))


def _naive(h: Column, plan: Plan) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(plan.horizon)), lambda k: F.element_at(h, -1))


def _drift(h: Column, plan: Plan) -> Column:
    last, n = F.element_at(h, -1), F.size(h)
    slope = F.when(n > 1, (last - h[0]) / (n - 1)).otherwise(0.0)
    return F.transform(F.sequence(F.lit(1), F.lit(plan.horizon)), lambda k: last + k * slope)


def _damped(h: Column, plan: Plan) -> Column:
    a, b, phi = plan.alpha, plan.beta, plan.phi
    start = F.struct(h[0].alias("level"), F.when(F.size(h) > 1, F.try_element_at(h, F.lit(2)) - h[0]).otherwise(0.0).alias("trend"))

    def step(s: Column, x: Column) -> Column:
        level = a * x + (1 - a) * (s["level"] + phi * s["trend"])
        return F.struct(level.alias("level"), (b * (level - s["level"]) + (1 - b) * phi * s["trend"]).alias("trend"))

    def project(s: Column) -> Column:
        damp = F.transform(F.sequence(F.lit(1), F.lit(plan.horizon)), lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda t, i: t + F.pow(F.lit(phi), i.cast("double"))))
        return F.transform(damp, lambda d: s["level"] + s["trend"] * d)

    return F.aggregate(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), start, step, project)


#: Models by name: an array of values to an array of the next ones.
MODELS = {"naive": _naive, "drift": _drift, "damped_trend": _damped}


def _array(series: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("week", F.col("mrr").cast("double").alias("x"))))
    return series.agg(rows.alias("rows")).select(F.transform("rows", lambda r: r["x"]).alias("x"), F.transform("rows", lambda r: r["week"]).alias("weeks"))


def backtest(series: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """A row for each origin, model and horizon: what was predicted from the weeks up to the origin, and what came."""
    n = F.size("x")
    origins = F.when(n - plan.horizon >= plan.least_history, F.sequence(F.lit(plan.least_history), n - plan.horizon, F.lit(plan.step))).otherwise(F.array().cast("array<int>"))
    known = _array(series).select("x", "weeks", F.explode(origins).alias("origin")).withColumn("h", F.slice("x", F.lit(1), F.col("origin")))
    models = F.array(*(F.struct(F.lit(m).alias("model"), f(F.col("h"), plan).alias("predicted")) for m, f in MODELS.items()))
    rows = known.select("origin", "x", F.element_at("weeks", F.col("origin")).alias("origin_week"), F.explode(models).alias("m"))
    flat = rows.select("origin", "origin_week", "x", F.col("m.model").alias("model"), F.posexplode("m.predicted").alias("k", "predicted"))
    out = flat.select("origin", "origin_week", "model", (F.col("k") + 1).alias("horizon"), "predicted", F.element_at("x", F.col("origin") + F.col("k") + 1).alias("actual"))
    error = F.col("predicted") - F.col("actual")
    return out.withColumns({"error": error, "abs_pct_error": F.when(F.col("actual") != 0, F.abs(error / F.col("actual")))})


def score(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.avg("abs_pct_error").alias("mape"), F.avg("error").alias("bias"), F.max("abs_pct_error").alias("worst"), F.count(F.lit(1)).alias("n"))


def score_by_horizon(results: DataFrame) -> DataFrame:
    return results.groupBy("horizon").pivot("model", list(MODELS)).agg(F.avg("abs_pct_error"))


def recent(results: DataFrame, origins: int = 5) -> DataFrame:
    w = Window.orderBy(F.desc("origin"))  # a row an origin, model and horizon
    return results.withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= origins).drop("__r")


def winner(results: DataFrame, origins: int = 5) -> DataFrame:
    """The model with the lowest recent error; the first by name of equals."""
    return score(recent(results, origins)).agg(F.min(F.struct("mape", "model")).alias("m")).select("m.model", "m.mape")


def bias_drift(results: DataFrame, horizon: int = 13) -> DataFrame:
    """By model, errors at one horizon: mean of the first half of origins, of the last three, and the last; null below six origins."""
    at = results.where(F.col("horizon") == horizon).groupBy("model", "origin").agg(F.avg("error").alias("error"))
    w = Window.partitionBy("model")
    n = at.withColumns({"k": F.row_number().over(w.orderBy("origin")), "n": F.count(F.lit(1)).over(w)})
    mean = lambda c: F.avg(F.when(c, F.col("error")))
    out = n.where("n >= 6").groupBy("model").agg(mean(F.col("k") <= F.floor(F.col("n") / 2)).alias("early_bias"), mean(F.col("k") > F.col("n") - 3).alias("late_bias"), mean(F.col("k") == F.col("n")).alias("latest_bias"))
    return out.withColumns({"sign_flipped": F.col("early_bias") * F.col("late_bias") < 0, "trending_up": F.col("late_bias") > F.col("early_bias")})


def intervals(results: DataFrame) -> DataFrame:
    """By model and horizon, exact percentiles of the relative error, interpolated."""
    relative = F.col("error") / F.col("actual")
    rows = results.where("actual <> 0").withColumn("relative", relative)
    return rows.groupBy("model", "horizon").agg(*(F.expr(f"percentile(relative, {p / 100})").alias(f"p{p:02d}") for p in (5, 50, 95)), F.avg("abs_pct_error").alias("mape"))


def forecast(series: DataFrame, plan: Plan = Plan(), results: DataFrame | None = None) -> DataFrame:
    """The next weeks by every model, corrected by its median error, with the bounds that its errors earn."""
    bands = intervals(backtest(series, plan) if results is None else results)
    models = F.array(*(F.struct(F.lit(m).alias("model"), f(F.col("x"), plan).alias("raw")) for m, f in MODELS.items()))
    rows = _array(series).where(F.size("x") > 0).select(F.element_at("weeks", -1).alias("last"), F.explode(models).alias("m")).select("last", "m.model", F.posexplode("m.raw").alias("k", "raw_forecast"))
    ahead = rows.select("model", (F.col("k") + 1).alias("horizon"), F.date_add("last", 7 * (F.col("k") + 1)).alias("week"), "raw_forecast")
    raw = F.col("raw_forecast")
    return ahead.join(bands, ["model", "horizon"]).select("model", "horizon", "week", "raw_forecast", (raw / (1 + F.col("p50"))).alias("forecast"), (raw / (1 + F.col("p95"))).alias("lower"), (raw / (1 + F.col("p05"))).alias("upper"))
