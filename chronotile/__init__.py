"""Data-cube and time-series analytics on Spark DataFrames."""
