"""Operators: DataFrames in, a DataFrame out; no reading, no collecting, no clock."""
