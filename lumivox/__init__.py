"""Array-valued scan analytics on Spark DataFrames."""
