"""Calendars, and the join of periods with the calendar points that they contain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .naming import own
from .running import running_sums


@dataclass(frozen=True)
class Grid:
    """Points from first to last: month starts, Sundays or days. Open periods end at as_of."""

    first: str
    last: str
    step: str = "month"  # month, week or day
    as_of: str | None = None

    @property
    def interval(self) -> Column:
        return F.expr({"month": "interval 1 month", "week": "interval 7 day", "day": "interval 1 day"}[self.step])

    def at_or_after(self, day: Column) -> Column:
        if self.step == "day":
            return day
        if self.step == "week":
            return F.next_day(F.date_sub(day, 1), "SUN")
        month = F.trunc(day, "MM")
        return F.when(month == day, day).otherwise(F.add_months(month, 1))

    def place(self, day: Column) -> Column:
        """The number of the last point at or before a day, counted from a point long ago."""
        if self.step == "month":
            return F.year(day) * 12 + F.month(day) - 1
        days = F.unix_date(day)
        return days if self.step == "day" else F.floor((days - 3) / 7).cast("int")  # the first Sunday is 4 January 1970

    def day_at(self, place: Column) -> Column:
        if self.step == "month":
            return F.make_date(F.floor(place / 12), place % 12 + 1, F.lit(1))
        return F.date_from_unix_date((place if self.step == "day" else 7 * place + 3).cast("int"))

    def points(self, spark: SparkSession, name: str) -> DataFrame:
        first, last = F.lit(self.first).cast("date"), F.lit(self.last).cast("date")
        span = F.sequence(self.at_or_after(first), last, self.interval)
        return spark.range(1).select(F.explode(span).alias(name))


def span(df: DataFrame, columns: list[str], name: str, step: str = "day") -> DataFrame:
    """The calendar of a table: every point from the first to the last day in the columns; none of a table without days.

    Months begin with the first day's, weeks with the Sunday at or after it. One aggregate with partial sums."""
    days = [F.col(c).cast("date") for c in columns]
    ends = df.agg(*(f(c).alias(f"{n}{i}") for n, f in (("a", F.min), ("z", F.max)) for i, c in enumerate(days)))
    pick = lambda f, n: f(*(F.col(f"{n}{i}") for i in range(len(days)))) if len(days) > 1 else F.col(f"{n}0")
    grid = Grid("", "", step)
    first, last = pick(F.least, "a"), pick(F.greatest, "z")
    start = F.trunc(first, "MM") if step == "month" else grid.at_or_after(first)
    return ends.select(F.explode(F.when(start <= last, F.sequence(start, last, grid.interval))).alias(name))


def asof_sums(periods: DataFrame, grid: Grid, name: str, sums: dict[str, Column], by: list[str] | None = None, start: str = "period_start", end: str = "period_end") -> DataFrame:
    """Sums over the periods that hold each grid point (start <= point < end; a null end is as_of), by key.

    A period counts from its first point and is taken away after its last one: two rows a period, however long it
    is, added up by point, and then running totals. Without ``by`` all points of the grid are there, with it those
    from the first one of each key on; where no period is, sums are 0.
    """
    by = by or []
    stop = F.coalesce(F.col(end), F.lit(grid.as_of or grid.last).cast("date"))
    lo = grid.at_or_after(F.greatest(F.col(start), F.lit(grid.first).cast("date")))
    hi = F.least(F.date_sub(stop, 1), F.lit(grid.last).cast("date"))
    last = grid.place(F.lit(grid.last).cast("date"))
    held = periods.select(*by, lo.alias("__lo"), hi.alias("__hi"), *(c.alias(n) for n, c in sums.items())).where("__lo <= __hi")
    side = lambda place, sign: F.struct(place.cast("bigint").alias("__at"), *((sign * F.col(n)).alias(n) for n in sums))
    changes = held.select(*by, F.inline(F.array(side(grid.place(F.col("__lo")), 1), side(grid.place(F.col("__hi")) + 1, -1)))).where(F.col("__at") <= last)
    zeros = [F.lit(0).alias(n) for n in sums]
    if by:
        starts = changes.groupBy(*by).agg(F.min("__at").alias("__from"))
        points = starts.select(*by, F.explode(F.sequence("__from", last.cast("bigint"))).alias("__at"), *zeros)
    else:
        points = grid.points(periods.sparkSession, "__day").select(grid.place(F.col("__day")).cast("bigint").alias("__at"), *zeros)
    by_point = changes.unionByName(points).groupBy(*by, "__at").agg(*(F.sum(n).alias(n) for n in sums))
    return running_sums(by_point, "__at", list(sums), by).select(grid.day_at(F.col("__at")).alias(name), *by, *sums)


def asof_expand(periods: DataFrame, grid: Grid, name: str, start: str = "period_start", end: str = "period_end") -> DataFrame:
    """A row for each period and grid point with start <= point < end; a null end is as_of.

    Points are generated from each period, so the join has no shuffle and no comparison of all periods with all
    points; what follows aggregates by point.
    """
    stop = F.coalesce(F.col(end), F.lit(grid.as_of or grid.last).cast("date"))
    lo = grid.at_or_after(F.greatest(F.col(start), F.lit(grid.first).cast("date")))
    hi = F.least(F.date_sub(stop, 1), F.lit(grid.last).cast("date"))
    a, b = own(periods, "__lo", "__hi")
    held = periods.withColumns({a: lo, b: hi}).where(F.col(a) <= F.col(b))
    return held.withColumn(name, F.explode(F.sequence(a, b, grid.interval))).drop(a, b)
