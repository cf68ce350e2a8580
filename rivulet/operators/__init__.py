"""Operators on DataFrames of flow records."""
