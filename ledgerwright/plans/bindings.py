"""The driver's tables seen as billing data: raw exports with the defects that cleaning is there for.

Each view is one SQL text of constructs that mean the same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST_MONTH, LAST_MONTH, AS_OF = "1995-01-01", "2001-08-01", "2001-08-01"
FIRST_WEEK, LAST_WEEK = "1995-01-01", "2001-07-29"
CUT_MONTH = "2001-06-01"
BEFORE, AFTER = "2001-01-01", "2001-06-01"

VIEWS = {
    "customers": """
SELECT c.c_custkey AS customer_id, c.c_name AS company_name, f.first_day AS signup_date,
  CASE c.c_custkey % 10 WHEN 0 THEN ' SMB ' WHEN 1 THEN 'smb' WHEN 2 THEN 'S.M.B.' WHEN 3 THEN 'Mid-Market' WHEN 4 THEN 'midmarket'
    WHEN 5 THEN 'MID MARKET' WHEN 6 THEN 'Enterprise' WHEN 7 THEN 'ent' WHEN 8 THEN c.c_mktsegment ELSE NULL END AS segment,
  CASE WHEN c.c_custkey % 50 = 7 THEN NULL ELSE c.c_mktsegment END AS industry,
  CASE WHEN c.c_custkey % 50 = 9 THEN NULL ELSE r.r_name END AS region,
  CASE c.c_custkey % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid' WHEN 2 THEN 'partner' ELSE 'outbound' END AS acquisition_channel
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day FROM {orders} GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey""",
    "known_customers": "SELECT c_custkey AS customer_id FROM {customer} WHERE c_acctbal >= 0",
    "subscriptions": """
SELECT subscription_id, customer_id, plan_tier, mrr, period_start, period_end, status, is_correction FROM (
  SELECT p.*, CASE WHEN nxt IS NULL AND st <> 'P' THEN CAST(NULL AS DATE) ELSE least(coalesce(nxt, period_start + 180), period_start + 180) END AS period_end,
    CASE WHEN nxt > period_start + 180 OR (nxt IS NULL AND st = 'P') THEN 'paused' WHEN st = 'F' THEN 'churned' WHEN st = 'P' THEN 'expanded' ELSE 'active' END AS status,
    FALSE AS is_correction
  FROM (
    SELECT o_orderkey AS subscription_id, o_custkey AS customer_id,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Enterprise' WHEN '2-HIGH' THEN 'Growth' WHEN '3-MEDIUM' THEN 'Growth' ELSE 'Starter' END AS plan_tier,
      CAST(o_totalprice AS DECIMAL(18,2)) AS mrr, CAST(o_orderdate AS DATE) AS period_start, o_orderstatus AS st,
      lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS nxt
    FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM {orders} o) o WHERE n = 1
  ) p
) s
UNION ALL
SELECT o_orderkey + 1000000000, o_custkey, 'Starter', CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.85 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)),
  CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 180, 'active', TRUE
FROM {orders} WHERE o_orderkey % 67 = 0""",
    "invoices": """
SELECT invoice_id, customer_id, subscription_id, issued_date,
  CASE WHEN refund THEN concat('(', CAST(base + addon AS STRING), ')') WHEN subscription_id % 20 = 0 THEN concat('$', CAST(base + addon AS STRING)) ELSE CAST(base + addon AS STRING) END AS amount,
  CASE WHEN refund THEN concat('(', CAST(base AS STRING), ')') ELSE CAST(base AS STRING) END AS base_amount,
  CASE WHEN refund THEN concat('(', CAST(addon AS STRING), ')') ELSE CAST(addon AS STRING) END AS addon_amount,
  CASE WHEN refund THEN 'refunded' WHEN l_linestatus = 'O' THEN 'unpaid' ELSE 'paid' END AS status,
  CASE WHEN refund AND line > 1 THEN concat('INV-', CAST(subscription_id AS STRING), '-', CAST(line - 1 AS STRING)) ELSE NULL END AS reverses_invoice_id
FROM (
  SELECT concat(CASE WHEN twin = 1 THEN 'INV-D' ELSE 'INV-' END, CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS invoice_id, o.o_custkey AS customer_id,
    l_orderkey AS subscription_id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS issued_date, l_returnflag = 'R' AS refund, l_linestatus,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS base,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS addon
  FROM (SELECT l.*, 0 AS twin FROM {lineitem} l UNION ALL SELECT l.*, 1 AS twin FROM {lineitem} l WHERE l_orderkey % 97 = 0) l
  JOIN {orders} o ON o.o_orderkey = l.l_orderkey
) i""",
    "usage_events": """
SELECT event_id, user_id AS customer_id, CAST(ts AS DATE) AS event_date,
  CASE WHEN event_id % 33 = 0 THEN ts - INTERVAL '6' HOUR ELSE ts END AS event_ts, value
FROM {events}""",
    "assignments": """
SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 100 < 54 THEN 'treatment' ELSE 'control' END AS variant, DATE '2001-01-01' + CAST(c_custkey % 30 AS INT) AS assigned_date
FROM {customer} WHERE c_custkey % 5 < 4
UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 100 < 54 THEN 'control' ELSE 'treatment' END, DATE '2001-01-01' + CAST(c_custkey % 30 + 9 AS INT)
FROM {customer} WHERE c_custkey % 25 = 1""",
}
TABLES = ("region", "nation", "customer", "orders", "lineitem", "events")


def raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All views as lazy DataFrames; only the columns a query uses are read."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return {name: spark.sql(text, **{t: tables[t] for t in TABLES if f"{{{t}}}" in text}) for name, text in VIEWS.items()}


def common_tables() -> str:
    """The views as common table expressions over tables of the driver's names."""
    return ",\n".join(f"raw_{name} AS ({text.format(**{t: t for t in TABLES})})" for name, text in VIEWS.items())
