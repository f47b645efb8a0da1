"""What keeps results right when keys are hot, series long, corrections few and rows late."""

from __future__ import annotations

import collections
import datetime as dt
import os
import random
from dataclasses import replace
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwright import contract as policy
from ledgerwright.functions.calendar import Grid, asof_expand, asof_sums, span
from ledgerwright.functions.money import parse_amount
from ledgerwright.functions.running import first_rows, running_sums
from ledgerwright.operators import cleaning, experiment, metrics, restatement, retention, star
from ledgerwright.plans import bindings, registry
from ledgerwright.streaming import pauses, refunds

from .test_engine import SUBS, C, D, with_parameter

SF = "/root/testdata/sf0.001"
DAY = dt.timedelta(1)


def random_subs(spark, n=400, customers=40, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a = D(2024, 1, 1) + rnd.randrange(500) * DAY
        b = None if rnd.random() < 0.2 else a + rnd.randrange(200) * DAY
        who = 0 if rnd.random() < 0.3 else rnd.choice([None, *range(1, customers)])
        rows.append((i, who, rnd.choice(("Starter", "Growth", None)), Decimal(rnd.randrange(1, 999)), a, b, rnd.choice(("active", "paused")), rnd.random() < 0.05))
    return spark.createDataFrame(rows, SUBS).withColumn("__block", F.lit("mine"))


# series


def test_running_sums_over_ranges(spark):
    rnd = random.Random(1)
    rows = [(k, i, rnd.randrange(-9, 9), Decimal(rnd.randrange(99))) for k in ("a", None) for i in sorted(rnd.sample(range(-500, 500), 200))]
    df = spark.createDataFrame(rows, "k string, i int, x int, __block decimal(10,2)").repartition(7)
    for width in (1, 16, 10_000):
        got = {(r["k"], r["i"]): (r["x"], r["__block"]) for r in running_sums(df, "i", ["x", "__block"], ["k"], width).collect()}
        want, sums = {}, collections.defaultdict(lambda: (0, Decimal(0)))
        for k, i, x, y in sorted(rows, key=lambda r: r[1]):
            sums[k] = (sums[k][0] + x, sums[k][1] + y)
            want[k, i] = sums[k]
        assert got == want
    assert running_sums(df.limit(0), "i", ["x"]).count() == 0


@pytest.mark.parametrize("grid", [Grid("2024-02-01", "2025-03-01", "month", "2025-03-20"), Grid("2024-01-14", "2025-01-05", "week"), Grid("2024-03-03", "2024-12-24", "day", "2025-01-01")])
def test_differences_equal_expansion(spark, grid):
    s = random_subs(spark)
    sums = {"mrr": F.col("mrr"), "n": F.lit(1).cast("bigint")}
    for by in ([], ["plan_tier"]):
        slow = asof_expand(s, grid, "p").groupBy("p", *by).agg(F.sum("mrr").alias("mrr"), F.count(F.lit(1)).alias("n"))
        fast = asof_sums(s, grid, "p", sums, by)
        key = lambda r: (r["p"], *(r[c] for c in by))
        want = {key(r): (r["mrr"], r["n"]) for r in slow.collect()}
        rows = fast.collect()
        assert len({key(r) for r in rows}) == len(rows)
        assert {key(r): (r["mrr"], r["n"]) for r in rows if r["n"]} == want
        assert all(r["mrr"] == 0 for r in rows if not r["n"])
    points = {r["p"] for r in grid.points(spark, "p").collect()}
    assert {r["p"] for r in asof_sums(s, grid, "p", sums).collect()} == points


def test_differences_shuffle_two_rows_a_period(spark):
    """A period of ten years costs no more than one of a day."""
    s = spark.createDataFrame([(i, i, "A", Decimal(1), D(2000, 1, 1), D(2020, 1, 1), "active", False) for i in range(50)], SUBS)
    plan = asof_sums(s, Grid("2000-01-01", "2020-01-01", "day"), "d", {"mrr": F.col("mrr")})._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(array(" in plan and "sequence(" not in plan  # the grid is a constant, and no period is written out


def test_span_of_a_table(spark):
    df = spark.createDataFrame([(D(2024, 1, 31), None), (D(2024, 2, 10), D(2024, 3, 3))], "a date, b date")
    assert [r[0] for r in span(df, ["a", "b"], "m", "month").collect()] == [D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)]
    assert [r[0] for r in span(df, ["a"], "w", "week").collect()] == [D(2024, 2, 4)]
    assert span(df, ["a", "b"], "d").count() == 33
    assert span(df.limit(0), ["a", "b"], "d").count() == 0


# first rows and timelines


def test_first_rows_of_a_hot_key(spark):
    rnd = random.Random(5)
    rows = [(None if rnd.random() < 0.5 else rnd.randrange(30), rnd.choice((None, *range(5))), rnd.randrange(3), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, z int, __first string").repartition(6)
    want = {}
    for k, o, z, _ in rows:
        mine = (o is not None, o or 0, z)
        want[k] = min(want.get(k, mine), mine)
    first = first_rows(df, ("k",), [F.col("o")])
    got = {r["k"]: (r["o"] is not None, r["o"] or 0, r["z"]) for r in first.collect()}
    assert got == want and first.columns == df.columns
    # every task keeps a row a key: what is shuffled does not grow with the key's rows
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_duplicates_are_what_is_left(spark):
    rows = [(f"i{k % 7}", 1, 1, D(2024, 1, 1), Decimal(5), "paid", k % 3) for k in range(60)] + [("z", None, None, None, None, None, 0)] * 3
    df = spark.createDataFrame(rows, "invoice_id string, customer_id int, subscription_id int, issued_date date, amount decimal(18,2), status string, n int")
    step = cleaning.remove_duplicates(df, [F.col("invoice_id"), F.col("n")])
    assert step.kept.count() == 2 and step.removed.count() == 61
    assert step.kept.where("customer_id = 1").first()["invoice_id"] == "i0"
    line = step.audit.first()
    assert line["rows_affected"] == 61 and line["dollars"] == 59 * 5
    known = spark.createDataFrame([(2,)], "customer_id int")
    fates = {r["disposition"]: r["count"] for r in cleaning.dispositions(df, known, [F.col("invoice_id"), F.col("n")]).groupBy("disposition").count().collect()}
    assert fates == {"duplicate": 61, "orphan": 2}


@pytest.mark.parametrize("width", [1, 16, 64, 5000])
def test_next_start_over_ranges(spark, width):
    s = random_subs(spark)
    rows = s.collect()
    starts = collections.defaultdict(set)
    for r in rows:
        starts[r["customer_id"]].add(r["period_start"])
    want = {r["subscription_id"]: None if r["period_end"] is None else min((x for x in starts[r["customer_id"]] if x > r["period_end"]), default=None) for r in rows}
    out = cleaning.next_start(s, width)
    assert {r["subscription_id"]: r["next_start"] for r in out.collect()} == want
    assert set(out.columns) == {*s.columns, "next_start"}


# audit


def test_observed_audit_equals_the_query(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    raw = bindings.raw(spark, SF)
    audit = cleaning.Audit()
    order = [F.col(c) for c in registry.ORDER]
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    write(cleaning.watch_customers(raw["customers"], audit), "customers")
    write(cleaning.watch_invoices(raw["invoices"], raw["known_customers"], order, audit), "fates")
    clean = spark.read.parquet(f"{tmp_path}/fates").where("disposition = 'clean'")
    write(cleaning.watch_refunds(clean, C, audit), "invoices")
    write(cleaning.watch_subscriptions(raw["subscriptions"], C, audit), "subscriptions")
    write(cleaning.watch_usage(raw["usage_events"], audit), "usage")
    told = {r["step"]: (r["table"], r["rows_affected"], float(r["dollars"])) for r in audit.lines(spark).collect()}
    asked = {r["step"]: (r["table"], r["rows_affected"], r["dollars"]) for r in registry.QUERIES["c11_audit"](spark, SF).collect()}
    assert told == asked and len(told) == 9
    assert spark.read.parquet(f"{tmp_path}/subscriptions").count() == registry.QUERIES["c06_corrections"](spark, SF).count()


# measures by period


def test_periods_show_their_last_date(spark):
    rows = [(20240101, 1, "A", Decimal(10)), (20240101, 2, "B", Decimal(5)), (20240201, 1, "A", Decimal(20)), (20250201, 1, "A", Decimal(30)), (20250201, 3, None, Decimal(1))]
    fact = spark.createDataFrame(rows, "date_key int, customer_id int, plan_tier string, mrr decimal(18,2)")
    got = {(r["period"], r["dimension"], r["value"]): (float(r["total_mrr"]), r["active_customers"], r["mrr_yoy"]) for r in star.revenue_by_period(fact, None, ["plan_tier"]).collect()}
    assert got["2024", "total", "all"] == got["2024-Q1", "total", "all"] == got["2024-02", "total", "all"] == (20, 1, None)
    assert got["2025", "total", "all"] == (31, 2, 0.55) and got["2025-02", "plan_tier", "A"] == (30, 1, 0.5)
    assert got["2024-01", "plan_tier", "B"] == (5, 1, None) and ("2024", "plan_tier", "B") not in got and not any(v is None for _, _, v in got)
    movement = spark.createDataFrame([(D(2024, 1, 1), 1.0), (D(2024, 3, 1), 3.0), (D(2024, 4, 1), 4.0)], "month date, nrr double")
    seen = {r["period"]: r["nrr"] for r in star.movement_by_period(movement).collect()}
    assert seen == {"2024": 4.0, "2024-Q1": 3.0, "2024-Q2": 4.0, "2024-01": 1.0, "2024-03": 3.0, "2024-04": 4.0}
    assert star.latest_movement(movement).first()["nrr"] == 4.0 and star.latest_movement(movement.limit(0)).count() == 0


# policy metrics


def changed(**formulas):
    return replace(C, metrics=C.metrics | {k: C.metrics[k] | {"formula": v} for k, v in formulas.items()})


def test_metrics_are_those_of_the_bridge(spark):
    d = registry.Data(spark, SF, C)
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    metrics.check(spark, C)
    made = metrics.by_month(C, metrics.tables(d.panel, d.dated.kept))
    assert set(made.columns) == {"month", *C.metrics}
    movement = retention.retention_bridge(d.panel)
    assert movement.count() > 10 and metrics.disagreements(made, movement).count() == 0
    # a formula is what is computed: another one gives other numbers
    other = changed(net_revenue_retention="(starting - churned) / nullif(starting, 0)", arr="pause_grace_days * mrr")
    new = metrics.by_month(other, metrics.tables(d.panel, d.dated.kept))
    assert {r["metric"] for r in metrics.disagreements(new, movement).collect()} == {"net_revenue_retention"}
    assert new.where("abs(arr - 60 * mrr) > 1e-6 * arr").count() == 0 and made.where("abs(arr - 12 * mrr) > 1e-6 * arr").count() == 0


@pytest.mark.parametrize(
    "formula",
    ["12 * nothing", "arr + 1", "sum(amount) + sum(now)", "mrr + starting", "1 + 1", "java_method(amount)", "sum('x')", "sum(amount); drop", "mrr + )", "was", "addon_revenue"],
)
def test_wrong_formulas_are_violations(spark, formula):
    with pytest.raises(policy.ContractViolation):
        metrics.check(spark, changed(arr=formula, addon_revenue="arr * 2"))


# restatement


def test_only_touched_months_are_rewritten(spark, tmp_path):
    grid = Grid("2024-01-01", "2025-06-01", "month", "2025-06-20")
    s = random_subs(spark).drop("__block")
    one = s.where("not is_correction")
    # a customer alone in a month, whose correction takes the month away
    row = [(9000, 77, "Growth", Decimal(7), D(2023, 12, 1), D(2024, 1, 2), "active", False)]
    one = one.where("period_start > '2024-02-05'").unionByName(spark.createDataFrame(row, SUBS))
    new = spark.createDataFrame([(9001, 77, "Growth", Decimal(7), D(2023, 12, 1), D(2023, 12, 9), "active", True), *((9100 + i, r["customer_id"], "Starter", Decimal(1), r["period_start"], r["period_start"] + 20 * DAY, "active", True) for i, r in enumerate(one.where("customer_id is not null and period_start < '2024-06-01'").orderBy("subscription_id").limit(3).collect()))], SUBS)
    path = str(tmp_path / "panel")
    retention.build_panel(one, grid).write.partitionBy("month").parquet(path)
    before = {f.parent.name: sorted(x.name for x in f.parent.glob("*.parquet")) for f in (tmp_path / "panel").glob("*/*.parquet")}
    after_all = one.unionByName(new)
    months = restatement.restate(spark, path, after_all, new, grid, C)
    now = {f.parent.name: sorted(x.name for x in f.parent.glob("*.parquet")) for f in (tmp_path / "panel").glob("*/*.parquet")}
    touched = {f"month={m}" for m in months}
    assert touched and {k: v for k, v in now.items() if k not in touched} == {k: v for k, v in before.items() if k not in touched} != {}
    assert "month=2024-01-01" in before and "month=2024-01-01" not in now
    rows = lambda df: sorted(map(repr, df.select("month", "customer_id", F.col("mrr").cast("double").alias("mrr"), "plan_tier").collect()))
    scratch = rows(retention.build_panel(cleaning.apply_corrections(after_all, C).kept, grid))
    assert rows(spark.read.parquet(path)) == scratch == rows(restatement.restated_panel(after_all, grid, C))
    restatement.restate(spark, path, after_all, new, grid, C)  # again
    assert rows(spark.read.parquet(path)) == scratch
    assert restatement.restate(spark, path, after_all, new, grid, with_parameter(restate_history_on_correction=False)) == []


# resampling


def test_resampling_is_exact(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(("control", "treatment")), D(2024, 1, 1), rnd.choice(("A", "B", None)), Decimal(rnd.randrange(50, 150)), Decimal(rnd.randrange(0, 160))) for i in range(700)]
    o = spark.createDataFrame(rows, "customer_id long, variant string, assigned_date date, segment string, pre decimal(28,2), post decimal(28,2)")
    replicates = 200
    for size in (10**6, 90):  # one bucket, and eight
        got = experiment.resampled(o.repartition(5), None, replicates, 3, size).groupBy("replicate", "segment", "variant").agg(*(F.sum(c).alias(c) for c in ("n", "pre", "post"))).collect()
        by_replicate = collections.Counter()
        for r in got:
            by_replicate[r["replicate"]] += r["n"]
        assert by_replicate == {k: 700 for k in range(replicates)}
        # the same draws by a plain loop over customers
        buckets = -(-700 // size)
        where = {r["customer_id"]: r["b"] for r in o.select("customer_id", F.pmod(F.xxhash64(F.col("customer_id").cast("string")), F.lit(buckets)).alias("b")).collect()}
        of = [sorted((r for r in rows if where[r[0]] == b), key=lambda r: str(r[0])) for b in range(buckets)]
        sizes = experiment.split_sizes([len(x) for x in of], 3, replicates)
        want: dict = collections.defaultdict(lambda: [0, 0, 0])
        for k in range(replicates):
            for b, own in enumerate(of):
                for r, times in zip(own, experiment.drawn(3, k, b, len(own), sizes[k, b])):
                    for i, v in enumerate((1, r[4], r[5])):
                        want[k, r[3], r[1]][i] += int(times) * v
        assert {(r["replicate"], r["segment"], r["variant"]): [r["n"], r["pre"], r["post"]] for r in got if r["n"]} == {k: [float(x) for x in v] for k, v in want.items() if v[0]}
    # draws of one customer: mean 1, variance 1 - 1 / n, and the interval is that of plain resampling
    one = np.array([sum(experiment.drawn(3, k, b, len(own), sizes[k, b])[:1].sum() for b, own in enumerate(of)) for k in range(replicates)])
    assert abs(one.mean() / buckets - 1) < 0.1
    interval = experiment.resampled_interval(o, replicates=600).first()
    generator = np.random.default_rng(1)
    x = [r for r in rows]

    def lift(sample):
        sums = collections.defaultdict(lambda: [0.0, 0.0, 0])
        for r in sample:
            s = sums[r[3], r[1]]
            s[0] += float(r[4])
            s[1] += float(r[5])
            s[2] += 1
        parts = [(sums[g, "treatment"][1] / sums[g, "treatment"][0] - sums[g, "control"][1] / sums[g, "control"][0], sums[g, "treatment"][0] + sums[g, "control"][0]) for g in ("A", "B", None)]
        return sum(a * w for a, w in parts) / sum(w for _, w in parts)

    plain = np.percentile([lift([x[i] for i in generator.integers(0, 700, 700)]) for _ in range(600)], [2.5, 97.5])
    assert interval["replicates"] == 600 and abs(interval["low"] - plain[0]) < 0.02 and abs(interval["high"] - plain[1]) < 0.02
    assert experiment.resampled_interval(o.limit(0)).first()["replicates"] == 0


# streams


def replay(spark, df, path, parts):
    """Write a table's rows as files, one a part, and read them as a stream, a file at a time."""
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_pauses_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pauses.PROVIDER)
    s = random_subs(spark, 250, 25).drop("__block").where("customer_id is not null")
    # a row of another customer, long after all, moves the watermark beyond every grace
    end = spark.createDataFrame([(9999, 999, "Growth", Decimal(1), D(2030, 1, 1), None, "active", False)], SUBS)
    events = pauses.events_of(s.unionByName(end)).withColumn("r", F.pmod(F.xxhash64("subscription_id", "kind"), F.lit(30)))
    # late by up to twenty days, in three files; the rest of time comes last
    late = F.unix_date(F.col("at").cast("date")) + F.col("r") * 2 / 3
    cut = lambda d: F.unix_date(F.lit(d).cast("date"))
    parts = [late < cut("2024-07-01"), (late >= cut("2024-07-01")) & (late < cut("2025-02-01")), (late >= cut("2025-02-01")) & (late < cut("2029-01-01")), late >= cut("2029-01-01")]
    stream = replay(spark, events, tmp_path / "events", parts).drop("r")

    def run(until):
        q = pauses.resolve_pauses(stream, C.pause_grace_days).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()

    run(None)
    run(None)  # a restart has nothing left to do, and repeats nothing
    got = sorted((r["subscription_id"], r["status"], r["next_start"], r["gap_days"]) for r in spark.read.parquet(str(tmp_path / "out")).where("customer_id <> 999").collect() if r["status"] == "paused_returned") + sorted((r["subscription_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).where("status = 'churned'").collect())
    batch = cleaning.resolve_pauses(s, C).kept.where("was_paused and period_end is not null").collect()
    want = sorted((r["subscription_id"], r["status"], r["next_start"], r["gap_days"]) for r in batch if r["status"] == "paused_returned") + sorted((r["subscription_id"], r["status"]) for r in batch if r["status"] == "churned")
    assert got == want and any(len(x) == 4 for x in want) and any(len(x) == 2 for x in want)


def test_refunds_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pauses.PROVIDER)
    rnd = random.Random(6)
    rows = [(f"i{k}", D(2024, 1, 1) + rnd.randrange(200) * DAY, None, Decimal(k)) for k in range(120)]
    rows += [("i5", D(2024, 3, 3), None, Decimal(1))]  # an id that two invoices have
    rows += [(f"r{k}", D(2024, 8, 1) + rnd.randrange(60) * DAY, rnd.choice([f"i{rnd.randrange(150)}", "i5", "nowhere"]), Decimal(-1)) for k in range(60)]
    end = [("end", D(2027, 1, 1), None, Decimal(0)), ("last", D(2027, 1, 1), "nothing", Decimal(0))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows + end)], "invoice_id string, issued_date date, reverses_invoice_id string, amount decimal(18,2), copy long")
    day = F.col("issued_date")
    parts = [day < D(2024, 5, 1), (day >= D(2024, 5, 1)) & (day < D(2024, 9, 1)), (day >= D(2024, 9, 1)) & (day < D(2026, 1, 1)), day >= D(2026, 1, 1)]
    stream = replay(spark, df, tmp_path / "in", parts)
    q = refunds.date_refunds(stream, stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = refunds.settle(spark.read.parquet(str(tmp_path / "out"))).where("invoice_id <> 'last'")
    want = cleaning.attribute_refunds(df, C).kept.where("reverses_invoice_id is not null and invoice_id <> 'last'")
    rows_of = lambda x: sorted((r["invoice_id"], r["effective_date"]) for r in x.collect())
    assert rows_of(got) == rows_of(want) and len(rows_of(got)) == 60
    assert any(r["effective_date"] == r["issued_date"] for r in got.collect())  # met none, and came when the watermark passed


def test_plain_amounts_are_cast_once(spark):
    """Plain and odd spellings alike; and whatever is rare stays out of the code that runs for each row."""
    texts = {
        "5": "5", "$1,234.56": "1234.56", "(500.00)": "-500", "($1,234.5)": "-1234.5", " (1.00) ": "-1", "-$3": "-3",
        "$-3": "-3", "5.000": "5", "(-4)": "4", "1e2": "100", ",5": "5", None: "0",
    }
    got = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1).select(parse_amount(F.col("v")).alias("a"))
    assert [r["a"] for r in got.collect()] == [Decimal(x) for x in texts.values()]
    for bad in ("", "()", "5)", "5.001", "1e-3"):
        with pytest.raises(Exception, match="not an amount"):
            spark.createDataFrame([(bad,)], "v string").select(parse_amount(F.col("v"))).collect()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(38,12)" not in plan.split("transform(")[0]


def test_panel_stays_with_its_customers(spark):
    """Tasks follow the rows, and panel, cohorts' changes and bridges do not move expanded months between them."""
    subs = registry.Data(spark, SF, policy.load()).restated.kept
    parted, plain = (retention.build_panel(subs, registry.MONTHS, parts=n) for n in (7, None))
    assert parted.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, plain.collect()))
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(month")
    assert moves(retention.cohort_changes(parted)) == 0 < moves(retention.cohort_changes(plain))
    assert sorted(map(str, retention.retention_bridge(parted).collect())) == sorted(map(str, retention.retention_bridge(plain).collect()))


def test_refunds_meet_what_they_reverse_in_one_pass(spark):
    """Rows are made once, whatever made them, and each comes out once."""
    day = lambda n: D(2024, 1, 1) + n * DAY
    rows = [("a", day(1), None), ("a", day(5), None), ("b", None, None), ("c", day(3), None), (None, day(4), None), (None, day(2), None), (None, day(6), "a"),
            ("d", day(7), "a"), ("d", day(8), "d"), ("e", day(9), "nowhere"), ("f", day(9), "b"), ("g", None, "c"), ("h", None, None)]
    rows += [(f"r{k}", day(20 + k), "a") for k in range(50)]
    df = spark.createDataFrame([(*r, Decimal(1), i, "x") for i, r in enumerate(rows)], "invoice_id string, issued_date date, reverses_invoice_id string, amount decimal(18,2), n int, __key string")
    latest: dict = {}
    for i, d, _ in rows:
        if i is not None and d is not None:
            latest[i] = max(latest.get(i, d), d)
    step = cleaning.attribute_refunds(df, C)
    assert step.kept.columns == [*df.columns, "effective_date"]
    got = [(r["n"], r["effective_date"], r["__key"]) for r in step.kept.orderBy("n").collect()]
    assert got == [(n, d if back is None else latest.get(back, d), "x") for n, (_, d, back) in enumerate(rows)]
    assert step.audit.first()["rows_affected"] == sum(back in latest and latest[back] != d for _, d, back in rows)
    plan = step.kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_metrics_make_the_panel_twice(spark):
    """Once for the panel's metrics, whose months are those of the result, and once for the changes."""
    panel = spark.createDataFrame([(D(2024, 1, 1), 1, Decimal(5), "A"), (D(2025, 1, 1), 1, Decimal(6), "A")], "month date, customer_id int, mrr decimal(28,2), plan_tier string")
    charges = spark.createDataFrame([(D(2025, 1, 1), Decimal(2)), (D(2026, 1, 1), Decimal(3))], "effective_date date, addon_amount decimal(18,2)")
    made = metrics.by_month(C, metrics.tables(panel, charges))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3
    assert [r["month"] for r in made.orderBy("month").collect()] == [D(2024, 1, 1), D(2025, 1, 1)] and set(made.columns) == {"month", *C.metrics}
    only = metrics.by_month(C, metrics.tables(panel, charges), ["addon_revenue"]) if "addon_revenue" in C.metrics else None
    assert only is None or [r["month"] for r in only.orderBy("month").collect()] == [D(2024, 1, 1), D(2025, 1, 1)]


def test_periods_count_customers_where_they_lie(spark):
    """A customer counts once a date and value however many facts it has, and no expanded fact is shuffled."""
    rows = [(20240101, 1, "A", 10, "x"), (20240101, 1, "A", 5, "x"), (20240101, 1, "B", 1, "x"), (20240101, 2, None, 7, "x"), (20240101, None, "A", 2, "x"), (20240101, 3, "B", 4, "x")]
    fact = spark.createDataFrame([(d, c, p, Decimal(m), o) for d, c, p, m, o in rows], "date_key int, customer_id int, plan_tier string, mrr decimal(28,2), own string")
    who = spark.createDataFrame([(1, "S"), (2, "S"), (3, None)], "customer_id int, segment string")
    seen = lambda df: {(r["dimension"], r["value"]): (r["total_mrr"], r["active_customers"]) for r in df.where("grain = 'year'").collect()}
    assert seen(star.revenue_by_period(fact, None, ["plan_tier"])) == {("total", "all"): (29, 3), ("plan_tier", "A"): (17, 1), ("plan_tier", "B"): (5, 2)}
    assert seen(star.revenue_by_period(fact, who, ["plan_tier", "segment"])) == {("total", "all"): (27, 3), ("plan_tier", "A"): (15, 1), ("plan_tier", "B"): (5, 2), ("segment", "S"): (23, 2)}
    plan = star.revenue_by_period(fact.repartition(7, "customer_id"), None, ["plan_tier"])._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "customer_id" in x]
    assert len(moved) <= 2 and all("REPARTITION_BY_NUM" in x for x in moved), moved
