"""Content-drift analytics on Spark DataFrames."""
