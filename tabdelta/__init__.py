"""Snapshot comparison of tabular data on Spark."""
