"""Operators: DataFrame to DataFrame, or Column to Column."""
