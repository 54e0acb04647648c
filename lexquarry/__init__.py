"""Search, cross-reference and corpus operations on Spark DataFrames."""
