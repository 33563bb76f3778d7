"""Columnar record archives and column analytics on Spark DataFrames."""
