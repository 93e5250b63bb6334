"""Performance-model analytics on Spark DataFrames."""
