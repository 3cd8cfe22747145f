"""Operators on tables; each takes and returns lazy DataFrames, with group keys in `by`."""
