"""varloom: rare-variant analytics on Spark DataFrames."""
