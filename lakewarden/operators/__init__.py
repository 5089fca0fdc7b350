"""Governance operators: DataFrames in, DataFrames out."""
