"""Operators on cohorts: DataFrames in, DataFrames out."""
