"""Navigation analytics on Spark DataFrames."""
