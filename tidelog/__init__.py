"""Versioned key-value logs as Spark DataFrames."""
