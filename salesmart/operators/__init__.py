"""One module per family of results; every function maps DataFrames to a DataFrame."""
