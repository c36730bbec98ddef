"""Operators: functions from DataFrames to DataFrames, with columns as parameters."""
