"""Recurring-revenue and retention analytics on Spark DataFrames."""
