"""Time-series and catalog analytics on Spark DataFrames."""
