"""Operators: DataFrames in, DataFrames out; lazy, batch over queries, with explicit tie-breaks."""
