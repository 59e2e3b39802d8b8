"""Quantitative-finance analytics over many series at once, as Spark DataFrame operations."""
