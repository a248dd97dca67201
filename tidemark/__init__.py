"""Append-only time-series analytics on Spark."""
