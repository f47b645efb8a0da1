"""The same results in DuckDB's SQL, written apart from the operators: range joins, plain grouping, recursion."""

from __future__ import annotations

from ..operators.experiment import POISSON, PRIME
from .bindings import AFTER, AS_OF, BEFORE, CUT_MONTH, FIRST_MONTH, FIRST_WEEK, LAST_MONTH, LAST_WEEK, common_tables

_M = "CAST({} AS DECIMAL(18,2))"
# A cast of anything but a number is an error, so parentheses count in a pair around the whole alone.
_PARSE = "CASE WHEN {0} IS NULL THEN CAST(0 AS DECIMAL(18,2)) WHEN trim({0}) LIKE '(%)' THEN -CAST(replace(replace(trim({0})[2:-2], '$', ''), ',', '') AS DECIMAL(18,2)) ELSE CAST(replace(replace(trim({0}), '$', ''), ',', '') AS DECIMAL(18,2)) END"
_KEY = "customer_id, subscription_id, issued_date, amount, status"

CHAIN = {
    "inv": f"SELECT invoice_id, customer_id, subscription_id, issued_date, {_PARSE.format('amount')} AS amount, {_PARSE.format('base_amount')} AS base_amount, {_PARSE.format('addon_amount')} AS addon_amount, status, reverses_invoice_id FROM raw_invoices",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY invoice_id, base_amount, addon_amount, reverses_invoice_id NULLS FIRST) AS n FROM inv",
    "uniq": "SELECT * FROM ranked WHERE n = 1",
    "dups": "SELECT * FROM ranked WHERE n > 1",
    "owned": "SELECT * FROM uniq WHERE customer_id IN (SELECT customer_id FROM raw_known_customers)",
    "orphans": "SELECT * FROM uniq WHERE customer_id NOT IN (SELECT customer_id FROM raw_known_customers)",
    "dated": "SELECT o.*, coalesce((SELECT max(i.issued_date) FROM owned i WHERE i.invoice_id = o.reverses_invoice_id), o.issued_date) AS effective_date FROM owned o",
    "subs": "SELECT * FROM raw_subscriptions s WHERE is_correction OR NOT EXISTS (SELECT 1 FROM raw_subscriptions c WHERE c.is_correction AND c.customer_id = s.customer_id AND c.period_start = s.period_start)",
    "resolved": """SELECT s.*, date_diff('day', period_end, next_start) AS gap FROM (
      SELECT s.*, (SELECT min(t.period_start) FROM subs t WHERE t.customer_id = s.customer_id AND t.period_start > s.period_end) AS next_start FROM subs s) s""",
    "cust": """SELECT customer_id, company_name, signup_date, acquisition_channel, coalesce(CASE WHEN lower(trim(segment)) IN ('smb', 's.m.b.') THEN 'SMB' WHEN lower(trim(segment)) IN ('mid-market', 'midmarket', 'mid market') THEN 'Mid-Market'
      WHEN lower(trim(segment)) IN ('enterprise', 'ent') THEN 'Enterprise' ELSE trim(segment) END, 'Unknown') AS segment, coalesce(industry, 'Unknown') AS industry, coalesce(region, 'Unknown') AS region FROM raw_customers""",
    "months": f"SELECT CAST(unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH)) AS DATE) AS month",
    "weeks": f"SELECT CAST(unnest(generate_series(DATE '{FIRST_WEEK}', DATE '{LAST_WEEK}', INTERVAL 7 DAY)) AS DATE) AS week",
    "live": f"SELECT m.month, s.* FROM months m JOIN subs s ON s.period_start <= m.month AND coalesce(s.period_end, DATE '{AS_OF}') > m.month",
    "panel": "SELECT month, customer_id, CAST(sum(mrr) AS DECIMAL(28,2)) AS mrr, arg_min(plan_tier, subscription_id) AS plan_tier FROM live GROUP BY month, customer_id",
}
_FLOWS = """SELECT {by} CAST(sum(was) AS DOUBLE) AS starting_mrr, -CAST(coalesce(sum(CASE WHEN now = 0 THEN was END), 0) AS DOUBLE) AS churned_mrr,
  CAST(coalesce(sum(CASE WHEN now > 0 AND now < was THEN now - was END), 0) AS DOUBLE) AS contraction_mrr,
  CAST(coalesce(sum(CASE WHEN now > 0 AND now > was THEN now - was END), 0) AS DOUBLE) AS expansion_mrr,
  CAST(sum(now) AS DOUBLE) AS ending_mrr, CAST(count(*) AS BIGINT) AS cohort_customers, CAST(count(*) FILTER (WHERE now = 0) AS BIGINT) AS churned_customers,
  CAST(sum(was) + -coalesce(sum(CASE WHEN now = 0 THEN was END), 0) + coalesce(sum(CASE WHEN now > 0 AND now < was THEN now - was END), 0) AS DOUBLE) AS gross,
  CAST(coalesce(sum(CASE WHEN now > 0 AND now <> was THEN now - was END), 0) - coalesce(sum(CASE WHEN now = 0 THEN was END), 0) AS DOUBLE) AS net
  FROM {source} GROUP BY {group}"""
_RATES = "SELECT * EXCLUDE (gross, net), -churned_mrr / starting_mrr AS churn_rate, -contraction_mrr / starting_mrr AS contraction_rate, expansion_mrr / starting_mrr AS expansion_rate, ending_mrr / starting_mrr AS nrr, gross / starting_mrr AS grr, CAST(churned_customers AS DOUBLE) / cohort_customers AS logo_churn_rate"
for _lag, _name in ((12, "movement"), (1, "monthly")):
    CHAIN[f"pairs_{_lag}"] = f"SELECT m.month, a.customer_id, a.plan_tier, a.mrr AS was, coalesce(b.mrr, 0) AS now FROM (SELECT DISTINCT month FROM panel) m JOIN panel a ON a.month = CAST(m.month - INTERVAL {_lag} MONTH AS DATE) LEFT JOIN panel b ON b.month = m.month AND b.customer_id = a.customer_id"
    CHAIN[f"flows_{_lag}"] = _FLOWS.format(by="month,", source=f"pairs_{_lag}", group="month HAVING count(*) >= 50")
    CHAIN[_name] = f"{_RATES}{', net / starting_mrr AS net_rate' if _lag == 1 else ''} FROM flows_{_lag}"
CHAIN |= {
    "assigned": "SELECT customer_id, variant, assigned_date FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY assigned_date, variant) AS n FROM raw_assignments) WHERE n = 1",
    "outcomes": f"""SELECT a.customer_id, a.variant, a.assigned_date, c.segment, p.mrr AS pre, coalesce(q.mrr, 0) AS post FROM raw_assignments a JOIN cust c USING (customer_id)
      JOIN panel p ON p.customer_id = a.customer_id AND p.month = DATE '{BEFORE}' LEFT JOIN panel q ON q.customer_id = a.customer_id AND q.month = DATE '{AFTER}' WHERE p.mrr > 0""",
    "firsts": "SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY assigned_date, variant) = 1",
    "pure": "SELECT * FROM firsts WHERE customer_id NOT IN (SELECT customer_id FROM raw_assignments GROUP BY customer_id HAVING count(DISTINCT variant) > 1)",
    "weekly": f"""SELECT week, CAST(coalesce(sum(mrr), 0) AS DECIMAL(28,2)) AS mrr, CAST(count(mrr) AS BIGINT) AS subscriptions FROM weeks w LEFT JOIN subs s
      ON s.period_start <= w.week AND coalesce(s.period_end, DATE '{AS_OF}') > w.week GROUP BY week HAVING coalesce(sum(mrr), 0) > 100000""",
    "pts": "SELECT row_number() OVER (ORDER BY week) AS i, week, CAST(mrr AS DOUBLE) AS x FROM weekly",
    "hs": "SELECT unnest(range(1, 14)) AS h",
    "holt": """SELECT p.i, p.x AS level, coalesce(q.x - p.x, 0.0) AS trend FROM pts p LEFT JOIN pts q ON q.i = 2 WHERE p.i = 1
      UNION ALL SELECT i, level, 0.1 * (level - level0) + 0.9 * 0.85 * trend FROM (SELECT p.i, 0.3 * p.x + 0.7 * (h.level + 0.85 * h.trend) AS level, h.level AS level0, h.trend FROM holt h JOIN pts p ON p.i = h.i + 1)""",
    "damp": "SELECT h, (SELECT sum(pow(0.85, k)) FROM (SELECT unnest(range(1, 14)) AS k) WHERE k <= h) AS d FROM hs",
    "ahead": """SELECT p.i AS origin, 'naive' AS model, h, p.x AS predicted FROM pts p, hs
      UNION ALL SELECT p.i, 'drift', h, p.x + h * ((p.x - f.x) / (p.i - 1)) FROM pts p, hs, (SELECT x FROM pts WHERE i = 1) f WHERE p.i > 1
      UNION ALL SELECT t.i, 'damped_trend', h, t.level + t.trend * d FROM holt t, damp""",
    "results": """SELECT a.origin, a.model, a.h AS horizon, a.predicted, p.x AS actual, a.predicted - p.x AS error, abs((a.predicted - p.x) / p.x) AS ape FROM ahead a JOIN pts p ON p.i = a.origin + a.h
      WHERE a.origin >= 52 AND (a.origin - 52) % 4 = 0 AND a.origin <= (SELECT max(i) FROM pts) - 13""",
    "recents": "SELECT * FROM results WHERE origin IN (SELECT DISTINCT origin FROM results ORDER BY origin DESC LIMIT 5)",
    "bands": "SELECT model, horizon, quantile_cont(error / actual, 0.05) AS p05, quantile_cont(error / actual, 0.5) AS p50, quantile_cont(error / actual, 0.95) AS p95, avg(ape) AS mape FROM results GROUP BY model, horizon",
    "future": """SELECT a.model, a.h AS horizon, CAST(p.week + 7 * CAST(a.h AS INT) AS DATE) AS week, a.predicted AS raw_forecast, a.predicted / (1 + p50) AS forecast, a.predicted / (1 + p95) AS lower, a.predicted / (1 + p05) AS upper
      FROM ahead a JOIN pts p ON p.i = a.origin JOIN bands b ON b.model = a.model AND b.horizon = a.h WHERE a.origin = (SELECT max(i) FROM pts)""",
    "lines": f"""SELECT coalesce(l.month, c.month) AS month, mrr, n_live, charged, n_charges, refunds, addons, n_rows FROM
      (SELECT month, subscription_id, sum(mrr) AS mrr, count(*) AS n_live FROM live GROUP BY ALL) l FULL JOIN
      (SELECT CAST(date_trunc('month', effective_date) AS DATE) AS month, subscription_id, coalesce(sum(base_amount) FILTER (WHERE reverses_invoice_id IS NULL), 0) AS charged, count(*) FILTER (WHERE reverses_invoice_id IS NULL) AS n_charges,
        coalesce(sum(base_amount) FILTER (WHERE reverses_invoice_id IS NOT NULL), 0) AS refunds, sum(addon_amount) AS addons, count(*) AS n_rows FROM dated WHERE date_trunc('month', effective_date) BETWEEN DATE '{FIRST_MONTH}' AND DATE '{LAST_MONTH}' GROUP BY ALL) c
      ON l.month = c.month AND l.subscription_id = c.subscription_id""",
    "bridge0": """SELECT month, coalesce(sum(mrr), 0) AS contracted_mrr, -coalesce(sum(mrr) FILTER (WHERE n_live > 0 AND coalesce(n_charges, 0) = 0), 0) AS less_not_invoiced,
      coalesce(sum(charged) FILTER (WHERE n_charges > 0 AND n_live IS NULL), 0) AS plus_invoiced_not_active, coalesce(sum(refunds), 0) AS plus_refunds_base,
      coalesce(sum(charged), 0) + coalesce(sum(refunds), 0) AS billed_base, coalesce(sum(addons), 0) AS plus_addons, CAST(coalesce(sum(n_rows), 0) AS BIGINT) AS invoice_count, CAST(coalesce(sum(n_live), 0) AS BIGINT) AS active_subscriptions,
      coalesce(sum(abs(charged - mrr)) FILTER (WHERE n_live > 0 AND n_charges > 0), 0) AS gross_difference FROM lines GROUP BY month""",
    "bridge": "SELECT *, billed_base - (contracted_mrr + less_not_invoiced + plus_invoiced_not_active + plus_refunds_base) AS residual, billed_base + plus_addons AS billed_total FROM bridge0",
    "back": "SELECT s.*, date_diff('day', period_end, next_start) AS days FROM resolved s WHERE period_end IS NOT NULL AND next_start IS NOT NULL",
    "gaps": """SELECT round_even(date_diff('day', period_end, nxt) / 30.44, 0) AS k FROM (SELECT s.*, (SELECT min(t.period_start) FROM raw_subscriptions t WHERE NOT t.is_correction AND t.customer_id = s.customer_id AND t.period_start > s.period_end) AS nxt
      FROM raw_subscriptions s WHERE NOT s.is_correction AND s.status = 'paused') WHERE nxt IS NOT NULL""",
    "curve": "SELECT CAST(k AS BIGINT) AS months_away, CAST(count(*) AS BIGINT) AS returns FROM gaps GROUP BY 1",
}
_SEG = """SELECT segment, CAST(count(*) FILTER (WHERE variant = 'control') AS BIGINT) AS control_customers, CAST(count(*) FILTER (WHERE variant = 'treatment') AS BIGINT) AS treatment_customers,
  CAST(sum(post) FILTER (WHERE variant = 'control') AS DOUBLE) / CAST(sum(pre) FILTER (WHERE variant = 'control') AS DOUBLE) AS control_retention,
  CAST(sum(post) FILTER (WHERE variant = 'treatment') AS DOUBLE) / CAST(sum(pre) FILTER (WHERE variant = 'treatment') AS DOUBLE) AS treatment_retention,
  CAST(sum(pre) AS DOUBLE) AS weight FROM {} GROUP BY segment HAVING least(count(*) FILTER (WHERE variant = 'control'), count(*) FILTER (WHERE variant = 'treatment')) >= 20"""
_LIFT = "SELECT round(sum((treatment_retention - control_retention) * weight) / sum(weight), 8) AS lift, CAST(count(*) AS BIGINT) AS strata FROM ({})"
_MONEY_COLS = "contracted_mrr less_not_invoiced plus_invoiced_not_active plus_refunds_base billed_base plus_addons gross_difference residual billed_total".split()
_D = "CAST({0} AS DOUBLE) AS {0}"
_SCORE = "SELECT model, round(avg(ape), 6) AS mape, round(avg(error), 6) AS bias, round(max(ape), 6) AS worst, CAST(count(*) AS BIGINT) AS n FROM {} GROUP BY model"
_REV = """SELECT {by}, CAST(coalesce(sum(mrr) FILTER (WHERE month = last), 0) AS DOUBLE) AS total_mrr, CAST(count(DISTINCT customer_id) FILTER (WHERE month = last) AS BIGINT) AS active_customers,
  CAST(coalesce(sum(mrr) FILTER (WHERE month < last), 0) AS DOUBLE) AS mrr_last_year, CAST(coalesce(sum(mrr) FILTER (WHERE month = last), 0) * 12 AS DOUBLE) AS total_arr,
  CASE WHEN count(DISTINCT customer_id) FILTER (WHERE month = last) > 0 THEN CAST(coalesce(sum(mrr) FILTER (WHERE month = last), 0) AS DOUBLE) / count(DISTINCT customer_id) FILTER (WHERE month = last) END AS mrr_per_customer,
  CASE WHEN coalesce(sum(mrr) FILTER (WHERE month < last), 0) <> 0 THEN CAST(coalesce(sum(mrr) FILTER (WHERE month = last), 0) - coalesce(sum(mrr) FILTER (WHERE month < last), 0) AS DOUBLE) / CAST(coalesce(sum(mrr) FILTER (WHERE month < last), 0) AS DOUBLE) END AS mrr_yoy
  FROM panel JOIN (SELECT max(month) AS last FROM panel) ON month = last OR month = CAST(last - INTERVAL 12 MONTH AS DATE) {join} GROUP BY {by}"""
_CUT = "SELECT '{0}' AS dimension, {0} AS value, was, now FROM (SELECT p.*, c.segment, c.acquisition_channel FROM pairs_12 p LEFT JOIN cust c USING (customer_id) WHERE p.month = DATE '" + CUT_MONTH + "') WHERE {0} IS NOT NULL"
_AUDIT = "SELECT '{}' AS step, '{}' AS \"table\", CAST(count(*) AS BIGINT) AS rows_affected, CAST(coalesce({}, 0) AS DOUBLE) AS dollars FROM {}"

_WEIGHT = " + ".join(f"CAST(u > {x!r} AS INT)" for x in POISSON)
_BOOTSTRAP = f"""WITH r AS (SELECT k, CAST(('0x' || substr(md5('7:replicate:' || k), 1, 8)) AS BIGINT) % {PRIME - 1} + 1 AS m FROM (SELECT unnest(range(600)) AS k)),
      c AS (SELECT *, CAST(('0x' || substr(md5('7:customer:' || customer_id), 1, 8)) AS BIGINT) % {PRIME - 1} + 1 AS x FROM pure),
      w AS (SELECT k, segment, variant, CAST(pre AS DOUBLE) AS pre, CAST(post AS DOUBLE) AS post, {_WEIGHT} AS w FROM (SELECT r.k, c.segment, c.variant, c.pre, c.post, CAST(c.x * r.m % {PRIME} AS DOUBLE) / {PRIME} AS u FROM c, r)),
      s AS (SELECT k, segment, coalesce(sum(w) FILTER (WHERE variant = 'control'), 0) AS cn, coalesce(sum(w * pre) FILTER (WHERE variant = 'control'), 0) AS c0, coalesce(sum(w * post) FILTER (WHERE variant = 'control'), 0) AS c1,
        coalesce(sum(w) FILTER (WHERE variant = 'treatment'), 0) AS tn, coalesce(sum(w * pre) FILTER (WHERE variant = 'treatment'), 0) AS t0, coalesce(sum(w * post) FILTER (WHERE variant = 'treatment'), 0) AS t1 FROM w GROUP BY k, segment),
      l AS (SELECT k, sum((t1 / t0 - c1 / c0) * (c0 + t0)) / sum(c0 + t0) AS lift FROM s WHERE least(cn, tn) >= 20 AND c0 > 0 AND t0 > 0 GROUP BY k)
      SELECT round(low, 8) AS low, round(high, 8) AS high, replicates, low <= 0 AND high >= 0 AS includes_zero FROM (SELECT quantile_cont(lift, {(1 - 0.95) / 2!r}) AS low, quantile_cont(lift, {1 - (1 - 0.95) / 2!r}) AS high, count(*) AS replicates FROM l)"""

_ENDS = "SELECT least(min(period_start), min(period_end)) AS a, greatest(max(period_start), max(period_end)) AS z FROM raw_subscriptions"
_GRAINS = "struct_pack(grain := 'year', period := strftime(month, '%Y')), struct_pack(grain := 'quarter', period := year(month) || '-Q' || quarter(month)), struct_pack(grain := 'month', period := strftime(month, '%Y-%m'))"

FINAL = {
    "s08_months": f"SELECT CAST(unnest(generate_series(date_trunc('month', a), z, INTERVAL 1 MONTH)) AS DATE) AS month FROM ({_ENDS})",
    "s08_sundays": f"SELECT day AS week FROM (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM ({_ENDS})) WHERE dayofweek(day) = 0",
    "c01_parse_amounts": "SELECT invoice_id, customer_id, issued_date, CAST(amount AS DOUBLE) AS amount, CAST(base_amount AS DOUBLE) AS base_amount, CAST(addon_amount AS DOUBLE) AS addon_amount, status FROM inv",
    "c02_amounts_audit": "SELECT 'parse amounts' AS step, CAST(count(*) AS BIGINT) AS rows_affected FROM raw_invoices WHERE concat(amount, base_amount, addon_amount) SIMILAR TO '.*[$,()].*'",
    "c03_unique_invoices": "SELECT customer_id, status, CAST(count(*) AS BIGINT) AS rows, CAST(sum(amount) AS DOUBLE) AS dollars FROM uniq GROUP BY ALL",
    "c03_duplicates": "SELECT customer_id, subscription_id, issued_date, CAST(amount AS DOUBLE) AS amount, status FROM dups",
    "c04_orphans": "SELECT customer_id, subscription_id, issued_date, CAST(amount AS DOUBLE) AS amount, status FROM orphans",
    "c04_owned": "SELECT customer_id, CAST(count(*) AS BIGINT) AS rows, CAST(sum(amount) AS DOUBLE) AS dollars FROM owned GROUP BY ALL",
    "c05_effective_dates": "SELECT reverses_invoice_id, issued_date, effective_date, CAST(amount AS DOUBLE) AS amount FROM dated WHERE reverses_invoice_id IS NOT NULL",
    "c06_corrections": "SELECT subscription_id, customer_id, plan_tier, CAST(mrr AS DOUBLE) AS mrr, period_start, period_end, status, is_correction FROM subs",
    "c07_pauses": "SELECT subscription_id, customer_id, plan_tier, CAST(mrr AS DOUBLE) AS mrr, period_start, period_end, CASE WHEN gap <= 60 THEN 'paused_returned' ELSE 'churned' END AS status, next_start, gap AS gap_days FROM resolved WHERE status = 'paused'",
    "c08_customers": "SELECT customer_id, segment, industry, region FROM cust",
    "c10_drift": "SELECT event_id, customer_id, CAST(event_ts AS DATE) <> event_date AS tz_drifted FROM raw_usage_events",
    "c11_audit": " UNION ALL ".join(
        (
            "SELECT 'standardise spelling' AS step, 'customers' AS \"table\", (SELECT count(DISTINCT segment) FROM raw_customers) - (SELECT count(DISTINCT c.segment) FROM cust c JOIN raw_customers r USING (customer_id) WHERE r.segment IS NOT NULL) AS rows_affected, 0.0::DOUBLE AS dollars",
            "SELECT 'label absent attributes' AS step, 'customers' AS \"table\", CAST(sum((segment IS NULL)::INT + (industry IS NULL)::INT + (region IS NULL)::INT) AS BIGINT) AS rows_affected, 0.0::DOUBLE AS dollars FROM raw_customers",
            _AUDIT.format("parse amounts", "invoices", "0", "raw_invoices WHERE concat(amount, base_amount, addon_amount) SIMILAR TO '.*[$,()].*'"),
            _AUDIT.format("remove duplicates", "invoices", "sum(amount)", "dups"),
            _AUDIT.format("quarantine orphans", "invoices", "sum(amount)", "orphans"),
            _AUDIT.format("attribute refunds", "invoices", "sum(amount)", "dated WHERE effective_date <> issued_date"),
            "SELECT 'apply corrections', 'subscriptions', (SELECT count(*) FROM raw_subscriptions) - (SELECT count(*) FROM subs), CAST((SELECT sum(mrr) FROM subs) - (SELECT sum(mrr) FROM raw_subscriptions WHERE NOT is_correction) AS DOUBLE)",
            _AUDIT.format("resolve pauses", "subscriptions", "sum(mrr)", "resolved WHERE status = 'paused' AND NOT coalesce(gap <= 60, FALSE)"),
            _AUDIT.format("flag time zone drift", "usage_events", "0", "raw_usage_events WHERE CAST(event_ts AS DATE) <> event_date"),
        )
    ),
    "c12_dispositions": """SELECT status, disposition, CAST(count(*) AS BIGINT) AS rows, CAST(sum(amount) AS DOUBLE) AS dollars FROM (SELECT status, 'duplicate' AS disposition, amount FROM dups UNION ALL SELECT status, 'orphan', amount FROM orphans UNION ALL SELECT status, 'clean', amount FROM owned) GROUP BY ALL""",
    "l01_ledger": """WITH s AS (SELECT 1 AS k, 1 AS g, amount FROM inv UNION ALL SELECT 2, -1, amount FROM dups UNION ALL SELECT 3, -1, amount FROM orphans UNION ALL SELECT 4, 1, amount FROM owned)
      SELECT CAST(k AS BIGINT) AS line_no, ['raw invoice rows', 'less duplicates', 'less orphans', 'clean invoice rows'][k] AS line, CAST(any_value(g) * count(*) AS BIGINT) AS rows, CAST(any_value(g) * sum(amount) AS DOUBLE) AS dollars FROM s GROUP BY k
      UNION ALL SELECT 5, 'unexplained', CAST(sum(CASE WHEN k = 4 THEN -1 ELSE g END) AS BIGINT), CAST(sum(CASE WHEN k = 4 THEN -amount ELSE g * amount END) AS DOUBLE) FROM s""",
    "l10_monthly_bridge": f"SELECT month, {', '.join(map(_D.format, _MONEY_COLS))}, invoice_count, active_subscriptions FROM bridge",
    "l12_verdict": "SELECT CAST(max(abs(residual)) AS DOUBLE) AS worst, CAST(count(*) FILTER (WHERE abs(residual) > 0.01) AS BIGINT) AS failures, CAST(count(*) AS BIGINT) AS months FROM bridge",
    "l14_coverage": "SELECT date_trunc('month', effective_date) BETWEEN DATE '1995-06-01' AND DATE '2001-06-01' AS inside, CAST(count(*) AS BIGINT) AS rows, CAST(sum(amount) AS DOUBLE) AS dollars FROM dated GROUP BY 1",
    "d01_panel": "SELECT month, customer_id, CAST(mrr AS DOUBLE) AS mrr, plan_tier FROM panel",
    "d02_retention_bridge": "SELECT * FROM movement",
    "d04_monthly_movement": "SELECT * FROM monthly",
    "d05_attribution": """WITH a AS (SELECT * FROM movement ORDER BY nrr DESC, month LIMIT 1), b AS (SELECT * FROM movement ORDER BY month DESC LIMIT 1),
      r AS (SELECT 'expansion' AS driver, 1.0::DOUBLE AS s, a.expansion_rate AS healthy, b.expansion_rate AS damaged, b.nrr - a.nrr AS delta FROM a, b UNION ALL SELECT 'contraction', -1.0, a.contraction_rate, b.contraction_rate, b.nrr - a.nrr FROM a, b UNION ALL SELECT 'churn', -1.0, a.churn_rate, b.churn_rate, b.nrr - a.nrr FROM a, b)
      SELECT driver, healthy, damaged, damaged - healthy AS change, (damaged - healthy) * s AS nrr_impact, CASE WHEN delta <> 0 THEN (damaged - healthy) * s / delta END AS share FROM r""",
    "d06_peak_and_latest": "SELECT (SELECT month FROM movement ORDER BY nrr DESC, month LIMIT 1) AS peak_month, (SELECT max(nrr) FROM movement) AS peak_nrr, (SELECT max(month) FROM movement) AS latest_month",
    "d07_retention_by": f"WITH u AS ({' UNION ALL '.join(_CUT.format(c) for c in ('segment', 'plan_tier', 'acquisition_channel'))}), f AS ({_FLOWS.format(by='dimension, value,', source='u', group='dimension, value')}) {_RATES}, round(-net, 2) AS mrr_lost FROM f WHERE starting_mrr <> 0",
    "d08_inflections": """SELECT month, round(churn_rate, 8) AS churn_rate, round(b, 8) AS baseline, round((churn_rate - b) / abs(b), 8) AS jump, CASE strftime(month, '%Y-%m') WHEN '1996-01' THEN 'first full year' WHEN '2001-07' THEN 'end of data' ELSE 'unexplained' END AS event
      FROM (SELECT month, churn_rate, avg(churn_rate) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM monthly) WHERE b <> 0 AND abs((churn_rate - b) / abs(b)) > 0.1""",
    "d09_smoothed": "SELECT month, round(net_rate, 8) AS net_rate, round(avg(net_rate) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 8) AS net_rate_smooth FROM monthly",
    "d11_churn_rates": "SELECT month, churn_rate AS revenue_churn_rate, logo_churn_rate FROM movement",
    "p03_pause_curve": "SELECT months_away, returns, CAST(sum(returns) OVER (ORDER BY months_away) AS DOUBLE) / (SELECT sum(returns) FROM curve) AS running_share FROM curve",
    "p04_within_two_months": "SELECT CAST(sum(returns) FILTER (WHERE months_away <= 2) AS DOUBLE) / sum(returns) AS share FROM curve",
    "r04_winbacks": "SELECT days <= 90 AS same_logo, CAST(count(*) AS BIGINT) AS returns, CAST(sum(mrr) AS DOUBLE) AS mrr FROM back GROUP BY 1",
    "e01_first_assignments": "SELECT * FROM assigned",
    "e02_sample_ratio": "SELECT c AS control, t AS treatment, (pow(c - (c + t) / 2.0, 2) + pow(t - (c + t) / 2.0, 2)) / ((c + t) / 2.0) AS chi_squared FROM (SELECT CAST(count(*) FILTER (WHERE variant = 'control') AS BIGINT) AS c, CAST(count(*) FILTER (WHERE variant = 'treatment') AS BIGINT) AS t FROM assigned)",
    "e03_contamination": "SELECT CAST(count(*) AS BIGINT) AS customers, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS contaminated, CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*) AS rate FROM (SELECT customer_id, count(DISTINCT variant) AS n FROM raw_assignments GROUP BY 1)",
    "e04_balance": """SELECT segment, c / ct AS control_share, t / tt AS treatment_share, t / tt - c / ct AS difference FROM (SELECT segment, CAST(count(*) FILTER (WHERE variant = 'control') AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE variant = 'treatment') AS DOUBLE) AS t FROM assigned JOIN cust USING (customer_id) GROUP BY 1)
      CROSS JOIN (SELECT CAST(count(*) FILTER (WHERE variant = 'control') AS DOUBLE) AS ct, CAST(count(*) FILTER (WHERE variant = 'treatment') AS DOUBLE) AS tt FROM assigned JOIN cust USING (customer_id))""",
    "e05_outcomes": "SELECT customer_id, variant, assigned_date, segment, CAST(pre AS DOUBLE) AS pre, CAST(post AS DOUBLE) AS post FROM outcomes",
    "e06_naive_readout": "SELECT variant, CAST(count(*) AS BIGINT) AS customers, CAST(sum(post) AS DOUBLE) / CAST(sum(pre) AS DOUBLE) AS retention, CAST(sum(pre) AS DOUBLE) / count(*) AS mean_before FROM firsts GROUP BY variant",
    "e06_naive_lift": "WITH v AS (SELECT variant, CAST(sum(post) AS DOUBLE) / CAST(sum(pre) AS DOUBLE) AS r FROM firsts GROUP BY variant) SELECT (SELECT r FROM v WHERE variant = 'control') AS control, (SELECT r FROM v WHERE variant = 'treatment') AS treatment, (SELECT r FROM v WHERE variant = 'treatment') - (SELECT r FROM v WHERE variant = 'control') AS lift",
    "e07_stratified_lift": _LIFT.format(_SEG.format("firsts")),
    "e08_corrected_lift": _LIFT.format(_SEG.format("pure")),
    "e08_bootstrap": _BOOTSTRAP,
    "e09_by_segment": f"SELECT segment, control_customers, treatment_customers, control_retention, treatment_retention, treatment_retention - control_retention AS lift, weight FROM ({_SEG.format('pure')})",
    "t01_weekly_revenue": "SELECT week, CAST(mrr AS DOUBLE) AS mrr, subscriptions FROM weekly",
    "t03_daily_revenue": f"""WITH n AS (SELECT plan_tier, CAST(unnest(generate_series(min(period_start), DATE '{LAST_MONTH}', INTERVAL 1 DAY)) AS DATE) AS day FROM subs WHERE period_end IS NULL OR period_end > period_start GROUP BY plan_tier)
      SELECT n.plan_tier, n.day, CAST(coalesce(sum(s.mrr), 0) AS DOUBLE) AS mrr, CAST(count(s.mrr) AS BIGINT) AS subscriptions FROM n LEFT JOIN subs s ON s.plan_tier = n.plan_tier AND s.period_start <= n.day AND coalesce(s.period_end, DATE '{AS_OF}') > n.day GROUP BY n.plan_tier, n.day""",
    "t02_growth": "WITH k AS (SELECT row_number() OVER (ORDER BY week DESC) AS k, CAST(mrr AS DOUBLE) AS x FROM weekly) SELECT (SELECT x FROM k WHERE k = 1) / (SELECT x FROM k WHERE k = 14) - 1 AS latest, (SELECT x FROM k WHERE k = 14) / (SELECT x FROM k WHERE k = 27) - 1 AS quarter_before, (SELECT x FROM k WHERE k = 53) / (SELECT x FROM k WHERE k = 66) - 1 AS year_before",
    "b01_backtest": "SELECT origin, model, horizon, round(predicted, 6) AS predicted, round(actual, 6) AS actual, round(error, 6) AS error, round(ape, 6) AS abs_pct_error FROM results",
    "b02_scores": _SCORE.format("results"),
    "b03_by_horizon": "SELECT horizon, round(avg(ape) FILTER (WHERE model = 'naive'), 6) AS naive, round(avg(ape) FILTER (WHERE model = 'drift'), 6) AS drift, round(avg(ape) FILTER (WHERE model = 'damped_trend'), 6) AS damped_trend FROM results GROUP BY horizon",
    "b04_recent_scores": _SCORE.format("recents"),
    "b05_winner": "SELECT model, round(mape, 6) AS mape FROM (SELECT model, avg(ape) AS mape FROM recents GROUP BY model) ORDER BY mape, model LIMIT 1",
    "b06_bias_drift": """WITH e AS (SELECT model, error, row_number() OVER (PARTITION BY model ORDER BY origin) AS k, count(*) OVER (PARTITION BY model) AS n FROM results WHERE horizon = 13),
      m AS (SELECT model, avg(error) FILTER (WHERE k <= n // 2) AS a, avg(error) FILTER (WHERE k > n - 3) AS l, avg(error) FILTER (WHERE k = n) AS z FROM e WHERE n >= 6 GROUP BY model)
      SELECT model, round(a, 4) AS early_bias, round(l, 4) AS late_bias, round(z, 4) AS latest_bias, a * l < 0 AS sign_flipped, l > a AS trending_up FROM m""",
    "b07_intervals": "SELECT model, horizon, round(p05, 8) AS p05, round(p50, 8) AS p50, round(p95, 8) AS p95, round(mape, 8) AS mape FROM bands",
    "b08_forecast": "SELECT model, horizon, week, round(raw_forecast, 4) AS raw_forecast, round(forecast, 4) AS forecast, round(lower, 4) AS lower, round(upper, 4) AS upper FROM future",
    "x01_dim_date": f"""SELECT d AS date, CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, CAST(year(d) AS BIGINT) AS year, 'Q' || quarter(d) AS quarter, CAST(month(d) AS BIGINT) AS month_num, strftime(d, '%b') AS month_name, CAST(date_trunc('month', d) AS DATE) AS month_start, strftime(d, '%Y-%m') AS year_month,
      CAST(strftime(d, '%Y%m') AS BIGINT) AS year_month_sort, CAST(date_trunc('week', d) AS DATE) AS week_start, day(d) = 1 AS is_month_start FROM (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS d FROM ({_ENDS}))""",
    "x02_dim_customer": "SELECT customer_id, company_name, segment, industry, region, acquisition_channel, signup_date, CAST(date_trunc('month', signup_date) AS DATE) AS signup_month, year(signup_date) || '-Q' || quarter(signup_date) AS signup_cohort FROM cust",
    "x03_dim_plan": "SELECT s.plan_tier, list_price, tier_rank, CAST(count(*) AS BIGINT) AS periods, min(period_start) AS first_sold FROM subs s LEFT JOIN (VALUES ('Starter', 99.0::DOUBLE, 1::BIGINT), ('Growth', 499.0::DOUBLE, 2::BIGINT), ('Enterprise', 2400.0::DOUBLE, 3::BIGINT)) t(plan_tier, list_price, tier_rank) ON t.plan_tier = s.plan_tier WHERE s.plan_tier IS NOT NULL GROUP BY ALL",
    "x04_fact_mrr": "SELECT CAST(strftime(month, '%Y%m%d') AS BIGINT) AS date_key, customer_id, plan_tier, CAST(mrr AS DOUBLE) AS mrr FROM panel",
    "x05_fact_movement": "SELECT *, CAST(strftime(month, '%Y%m%d') AS BIGINT) AS date_key FROM movement",
    "x06_fact_forecast": """SELECT CAST(strftime(week, '%Y%m%d') AS BIGINT) AS date_key, week, round(CAST(mrr AS DOUBLE), 4) AS actual, CAST(NULL AS BIGINT) AS horizon, CAST(NULL AS DOUBLE) AS raw_forecast, CAST(NULL AS DOUBLE) AS forecast, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, CAST(NULL AS VARCHAR) AS model FROM weekly
      UNION ALL SELECT CAST(strftime(week, '%Y%m%d') AS BIGINT), week, NULL, horizon, round(raw_forecast, 4), round(forecast, 4), round(lower, 4), round(upper, 4), model FROM future WHERE model = 'drift'""",
    "x07_fact_reconciliation": f"SELECT month, CAST(strftime(month, '%Y%m%d') AS BIGINT) AS date_key, {', '.join(map(_D.format, _MONEY_COLS))}, invoice_count, active_subscriptions FROM bridge",
    "k01_revenue_by_segment": _REV.format(by="segment", join="JOIN cust USING (customer_id)"),
    "k01_revenue_by_plan": _REV.format(by="plan_tier", join=""),
    "k13_revenue_by_channel": _REV.format(by="acquisition_channel", join="JOIN cust USING (customer_id)"),
    "k13_revenue_by_cohort": _REV.format(by="signup_cohort", join="JOIN (SELECT customer_id, year(signup_date) || '-Q' || quarter(signup_date) AS signup_cohort FROM cust) USING (customer_id)"),
    "k13_revenue_by_plan_rank": _REV.format(by="tier_rank, plan_tier", join="JOIN (VALUES ('Starter', 1::BIGINT), ('Growth', 2::BIGINT), ('Enterprise', 3::BIGINT)) t(plan_tier, tier_rank) USING (plan_tier)"),
    "k02_revenue_by_period": f"""WITH p AS (SELECT month, unnest([{_GRAINS}]) AS g FROM (SELECT DISTINCT month FROM panel)), l AS (SELECT g.grain AS grain, g.period AS period, max(month) AS last FROM p GROUP BY 1, 2),
      f AS (SELECT month, customer_id, mrr, unnest([struct_pack(dimension := 'total', value := 'all'), struct_pack(dimension := 'segment', value := segment), struct_pack(dimension := 'plan_tier', value := plan_tier), struct_pack(dimension := 'acquisition_channel', value := acquisition_channel)]) AS d FROM panel JOIN cust USING (customer_id)),
      m AS (SELECT grain, period, last, d.dimension AS dimension, d.value AS value, coalesce(sum(mrr) FILTER (WHERE month = last), 0) AS now, coalesce(sum(mrr) FILTER (WHERE month < last), 0) AS was, count(DISTINCT customer_id) FILTER (WHERE month = last) AS n FROM l JOIN f ON f.month = l.last OR f.month = CAST(l.last - INTERVAL 12 MONTH AS DATE) WHERE d.value IS NOT NULL GROUP BY ALL)
      SELECT grain, period, CAST(strftime(last, '%Y%m%d') AS BIGINT) AS last_date_key, dimension, value, CAST(now AS DOUBLE) AS total_mrr, CAST(n AS BIGINT) AS active_customers, CAST(was AS DOUBLE) AS mrr_last_year, CAST(now * 12 AS DOUBLE) AS total_arr, CASE WHEN n > 0 THEN CAST(now AS DOUBLE) / n END AS mrr_per_customer, CASE WHEN was <> 0 THEN CAST(now - was AS DOUBLE) / CAST(was AS DOUBLE) END AS mrr_yoy FROM m""",
    "k06_movement_by_period": f"WITH p AS (SELECT movement.*, unnest([{_GRAINS}]) AS g FROM movement) SELECT * EXCLUDE (g), g.grain AS grain, g.period AS period FROM p QUALIFY row_number() OVER (PARTITION BY g.grain, g.period ORDER BY month DESC) = 1",
    "m01_policy_metrics": """WITH c AS (SELECT month, count(*) AS n, count(*) FILTER (WHERE now = 0) AS gone, CAST(sum(was) AS DOUBLE) AS a, CAST(coalesce(sum(was) FILTER (WHERE now = 0), 0) AS DOUBLE) AS lost, CAST(coalesce(sum(was - now) FILTER (WHERE now <> 0 AND now < was), 0) AS DOUBLE) AS less, CAST(coalesce(sum(now - was) FILTER (WHERE now <> 0 AND now > was), 0) AS DOUBLE) AS more FROM pairs_12 GROUP BY month)
      SELECT p.month, round(mrr, 8) AS mrr, round(12 * mrr, 8) AS arr, round(addon, 8) AS addon_revenue, round(CAST(gone AS DOUBLE) / nullif(n, 0), 8) AS logo_churn, round(lost / nullif(a, 0), 8) AS revenue_churn, round(less / nullif(a, 0), 8) AS contraction, round(more / nullif(a, 0), 8) AS expansion, round((a - lost - less) / nullif(a, 0), 8) AS gross_revenue_retention, round((a - lost - less + more) / nullif(a, 0), 8) AS net_revenue_retention
      FROM (SELECT month, CAST(sum(mrr) AS DOUBLE) AS mrr FROM panel GROUP BY month) p LEFT JOIN (SELECT CAST(date_trunc('month', effective_date) AS DATE) AS month, CAST(sum(addon_amount) AS DOUBLE) AS addon FROM dated GROUP BY 1) USING (month) LEFT JOIN c USING (month)""",
    "c06_touched_months": f"""WITH k AS (SELECT DISTINCT customer_id, period_start FROM raw_subscriptions WHERE is_correction), t AS (SELECT * FROM raw_subscriptions s WHERE is_correction OR (customer_id, period_start) IN (SELECT (customer_id, period_start) FROM k))
      SELECT m.month, CAST(coalesce(sum(mrr) FILTER (WHERE NOT is_correction), 0) AS DOUBLE) AS replaced_mrr, CAST(coalesce(sum(mrr) FILTER (WHERE is_correction), 0) AS DOUBLE) AS corrected_mrr, CAST(count(DISTINCT customer_id) AS BIGINT) AS customers FROM months m JOIN t ON t.period_start <= m.month AND coalesce(t.period_end, DATE '{AS_OF}') > m.month GROUP BY m.month""",
    "d01_restated_panel": "SELECT month, customer_id, CAST(mrr AS DOUBLE) AS mrr, plan_tier FROM panel",
    "k05_latest_movement": "SELECT * FROM movement ORDER BY month DESC LIMIT 1",
}


def _needed(text: str) -> list[str]:
    """Names of the chain that a text uses, directly or not, in the order of the chain."""
    import re

    found: set[str] = set()

    def visit(t: str) -> None:
        for name in set(re.findall(r"\b\w+\b", t)) & CHAIN.keys() - found:
            found.add(name)
            visit(CHAIN[name])

    visit(text)
    return [n for n in CHAIN if n in found]


def oracle(name: str) -> str:
    parts = [common_tables()] + [f"{n} AS MATERIALIZED ({CHAIN[n]})" if n != "holt" else f"{n} AS ({CHAIN[n]})" for n in _needed(FINAL[name])]
    joined = ",\n".join(parts)
    return f"WITH RECURSIVE {joined}\n{FINAL[name]}" if not FINAL[name].lstrip().startswith("WITH ") else f"WITH RECURSIVE {joined},\n{FINAL[name].lstrip()[5:]}"


ORACLES = {name: oracle(name) for name in FINAL}
