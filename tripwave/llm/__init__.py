"""Operators of a training-data pipeline: every one maps DataFrames to DataFrames."""
