"""Relational, time-series, ranking and model operators on DataFrames."""
