"""Content-addressed snapshot analytics on Spark DataFrames."""
