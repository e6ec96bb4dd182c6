"""Operators: every one is (DataFrame, parameters) -> DataFrame."""
