"""Star schema and the measures on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import Grid, span
from ..functions.money import ratio, total
from ..functions.naming import own

# Plans, their list prices and order.
PLANS = (("Starter", "99.00", 1), ("Growth", "499.00", 2), ("Enterprise", "2400.00", 3))


def date_key(day: Column | str) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def date_columns(days: DataFrame) -> DataFrame:
    """The calendar's attributes of a table of days (date)."""
    d = F.col("date")
    return days.select(
        "date", date_key(d).alias("date_key"), F.year(d).alias("year"), F.concat(F.lit("Q"), F.quarter(d)).alias("quarter"), F.month(d).alias("month_num"), F.date_format(d, "MMM").alias("month_name"),
        F.trunc(d, "MM").alias("month_start"), F.date_format(d, "yyyy-MM").alias("year_month"), F.date_format(d, "yyyyMM").cast("int").alias("year_month_sort"), F.date_sub(d, F.weekday(d)).alias("week_start"), (F.dayofmonth(d) == 1).alias("is_month_start"),
    )


def dim_date(spark: SparkSession, first: str, last: str) -> DataFrame:
    return date_columns(Grid(first, last, "day").points(spark, "date"))


def dim_date_of(facts: DataFrame, columns: list[str]) -> DataFrame:
    """The calendar from the first to the last day that a table has in the columns."""
    return date_columns(span(facts, columns, "date"))


def dim_customer(customers: DataFrame) -> DataFrame:
    d = F.col("signup_date")
    return customers.select("customer_id", "company_name", "segment", "industry", "region", "acquisition_channel", "signup_date", F.trunc(d, "MM").alias("signup_month"), F.concat_ws("-Q", F.year(d), F.quarter(d)).alias("signup_cohort"))


def _price_list() -> Column:
    return F.array(*(F.struct(F.lit(p).alias("plan_tier"), F.lit(v).cast("decimal(18,2)").alias("list_price"), F.lit(r).alias("tier_rank")) for p, v, r in PLANS))


def dim_plan(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(_price_list()))


def dim_plan_of(subscriptions: DataFrame) -> DataFrame:
    """The plans that subscriptions have, with list price and rank (null where the price list lacks them), and how they sell."""
    sold = subscriptions.where("plan_tier is not null").groupBy("plan_tier").agg(F.count(F.lit(1)).alias("periods"), F.min("period_start").alias("first_sold"))
    listed = F.try_element_at(F.filter(_price_list(), lambda p: p["plan_tier"] == F.col("plan_tier")), F.lit(1))
    return sold.withColumn("listed", listed).select("plan_tier", "listed.list_price", "listed.tier_rank", "periods", "first_sold")


def with_date_key(fact: DataFrame, day: str) -> DataFrame:
    return fact.withColumn("date_key", date_key(day))


def fact_mrr(panel: DataFrame) -> DataFrame:
    return panel.select(date_key("month").alias("date_key"), "customer_id", "plan_tier", "mrr")


def fact_forecast(series: DataFrame, forecasts: DataFrame, model: str) -> DataFrame:
    actual = series.select(date_key("week").alias("date_key"), "week", F.col("mrr").cast("double").alias("actual"))
    ahead = forecasts.where(F.col("model") == model).select(date_key("week").alias("date_key"), "week", "horizon", "raw_forecast", "forecast", "lower", "upper", "model")
    return actual.unionByName(ahead, allowMissingColumns=True)


def revenue_by(fact: DataFrame, attributes: DataFrame | None, by: list[str]) -> DataFrame:
    """Semi-additive measures at the last date that has facts: revenue, yearly revenue, customers, mean, and growth on the year.

    The last date comes first, as one row; of the facts only those of the two dates are joined and summed.
    """
    day = lambda c: F.to_date(c.cast("string"), "yyyyMMdd")
    last, then = own(fact, "__last", "__then")
    ends = fact.agg(F.max("date_key").alias(last)).withColumn(then, date_key(F.add_months(day(F.col(last)), -12)))
    now, before = F.col("date_key") == F.col(last), F.col("date_key") == F.col(then)
    dated = fact.join(F.broadcast(ends), now | before)
    keyed = dated.join(attributes, "customer_id") if attributes is not None else dated
    out = keyed.groupBy(*by).agg(total(F.when(now, F.col("mrr"))).alias("total_mrr"), F.count_distinct(F.when(now, F.col("customer_id"))).alias("active_customers"), total(F.when(before, F.col("mrr"))).alias("mrr_last_year"))
    mrr = F.col("total_mrr")
    return out.withColumns({"total_arr": (mrr * 12).cast("decimal(28,2)"), "mrr_per_customer": ratio(mrr, F.col("active_customers")), "mrr_yoy": ratio(mrr - F.col("mrr_last_year"), F.col("mrr_last_year"))})


#: Periods that measures are taken over, and how a day names the one it is in.
PERIODS = {"year": lambda d: F.date_format(d, "yyyy"), "quarter": lambda d: F.concat_ws("-Q", F.year(d), F.quarter(d)), "month": lambda d: F.date_format(d, "yyyy-MM")}


def _periods(day: Column) -> Column:
    return F.array(*(F.struct(F.lit(grain).alias("grain"), of(day).alias("period")) for grain, of in PERIODS.items()))


def revenue_by_period(fact: DataFrame, attributes: DataFrame | None, by: list[str]) -> DataFrame:
    """Semi-additive measures of every year, quarter and month, in total and by each attribute: one row for each grain,
    period, dimension and value.

    A stock is never added up over time: a period shows what there is at the last of its dates that has facts, and the
    year before is the same date a year earlier. Facts are summed up by date first, in total and by attribute,
    and a customer counts once for each; then periods look up the dates they need, a handful of rows each. Absent values of an attribute
    are left out, and a period in which an attribute's value has nothing at the last date shows 0 for it if it had
    something a year before.
    """
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    keyed = fact.join(attributes, "customer_id") if attributes is not None else fact
    # by customer first: facts that lie with their customers are told apart where they are, and no expanded row is moved
    sides = F.array(*(F.struct(F.lit(n).alias("dimension"), v.alias("value")) for n, v in (("total", F.lit("all")), *((c, F.col(c).cast("string")) for c in by))))
    told = keyed.select("date_key", "customer_id", "mrr", F.inline(sides)).where("value is not null")
    one = told.groupBy("date_key", "dimension", "value", "customer_id").agg(F.sum("mrr").alias("mrr"))
    daily = one.groupBy("date_key", "dimension", "value").agg(total("mrr").alias("mrr"), F.count("customer_id").alias("customers"))
    dates = fact.select("date_key").distinct().select(F.inline(_periods(day)), "date_key")
    last = dates.groupBy("grain", "period").agg(F.max("date_key").alias("date_key"))
    then = date_key(F.add_months(day, -12))
    sides = F.array(F.struct(F.col("date_key").alias("at"), F.lit(True).alias("now")), F.struct(then.alias("at"), F.lit(False).alias("now")))
    wanted = last.select("grain", "period", F.col("date_key").alias("last_date_key"), F.inline(sides))  # two rows a period of the calendar
    found = daily.join(F.broadcast(wanted), daily["date_key"] == wanted["at"])
    now = F.col("now")
    out = found.groupBy("grain", "period", "last_date_key", "dimension", "value").agg(total(F.when(now, F.col("mrr"))).alias("total_mrr"), F.coalesce(F.sum(F.when(now, F.col("customers"))), F.lit(0)).cast("bigint").alias("active_customers"), total(F.when(~now, F.col("mrr"))).alias("mrr_last_year"))
    mrr = F.col("total_mrr")
    return out.withColumns({"total_arr": (mrr * 12).cast("decimal(28,2)"), "mrr_per_customer": ratio(mrr, F.col("active_customers")), "mrr_yoy": ratio(mrr - F.col("mrr_last_year"), F.col("mrr_last_year"))})


def movement_by_period(movement: DataFrame) -> DataFrame:
    """Retention measures of every year, quarter and month: those of its last month with facts, looked up and never
    recomputed, as rates of different months do not add up."""
    day = F.col("month")
    periods = movement.select(F.inline(_periods(day)), F.struct(*movement.columns).alias("row"))
    return periods.groupBy("grain", "period").agg(F.max_by("row", F.col("row.month")).alias("row")).select("grain", "period", "row.*")


def latest_movement(movement: DataFrame) -> DataFrame:
    """Retention measures as of the last month with facts; looked up, never recomputed."""
    return movement.agg(F.max_by(F.struct(*movement.columns), "month").alias("row")).where("row is not null").select("row.*")
