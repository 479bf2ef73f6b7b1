"""Graph and sparse-matrix analytics on Spark DataFrames."""
