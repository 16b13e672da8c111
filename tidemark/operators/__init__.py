"""Operators: functions from DataFrames to DataFrames (or to a fitted model)."""
