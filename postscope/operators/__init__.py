"""Operators: DataFrame -> DataFrame functions with no action inside."""
