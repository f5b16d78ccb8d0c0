"""Operators of the customer pipeline, each a function from DataFrames to DataFrames."""
