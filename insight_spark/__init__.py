"""Profiling, cleaning, metrics, forecasts and report tables for tabular data on Spark."""
