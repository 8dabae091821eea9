"""The operators: pure functions from fact DataFrames to DataFrames."""
