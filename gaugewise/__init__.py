"""Plausibility screening of daily time series on Spark."""
