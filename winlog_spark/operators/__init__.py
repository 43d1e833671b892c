"""Operators that take and return DataFrames of events."""
