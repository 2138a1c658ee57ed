"""Keyed vector state, gradient aggregation and click-log analytics on Spark DataFrames."""

__version__ = "0.1.0"
