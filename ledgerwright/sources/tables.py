"""Schemas, readers and writers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the raw exports. Amounts and dates of invoices arrive as text.
SCHEMAS = {
    "customers": "customer_id string, company_name string, signup_date date, segment string, industry string, region string, acquisition_channel string",
    "subscriptions": "subscription_id string, customer_id string, plan_tier string, seats bigint, mrr decimal(18,2), period_start date, period_end date, status string, is_correction boolean",
    "invoices": "invoice_id string, customer_id string, subscription_id string, issued_date string, amount string, base_amount string, addon_amount string, status string, paid_date string, reverses_invoice_id string",
    "usage_events": "customer_id string, event_date timestamp_ntz, active_seats bigint, api_calls bigint, event_ts timestamp_ntz",
    "experiment_assignments": "customer_id string, variant string, assigned_date date",
}


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; never inferred. row_id keeps the order of the rows in their files."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n"))
    return rows.select("*", place.alias("row_id"))


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All raw tables: invoices from CSV, the others from Parquet."""
    out = {t: spark.read.schema(s).parquet(f"{folder}/{t}.parquet") for t, s in SCHEMAS.items() if t != "invoices"}
    invoices = read_csv(spark, f"{folder}/invoices.csv", SCHEMAS["invoices"])
    return out | {"invoices": invoices.withColumn("issued_date", F.col("issued_date").cast("date"))}


def write_parquet(df: DataFrame, folder: str, table: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/{table}.parquet")


def write_csv(df: DataFrame, folder: str, table: str, single_file: bool = True) -> None:
    """CSV with a header, as one file for a small table that people open."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(f"{folder}/{table}.csv")


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
