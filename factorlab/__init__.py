"""Intraday factor research on Spark DataFrames."""
