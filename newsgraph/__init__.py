"""News and event analytics on Spark DataFrames."""
