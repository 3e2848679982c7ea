"""Wiki analytics on Spark DataFrames."""
