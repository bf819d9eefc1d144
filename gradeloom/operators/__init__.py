"""Operators: each takes and returns data frames."""
