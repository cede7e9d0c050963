"""Manufacturing yield analytics on Spark DataFrames."""
