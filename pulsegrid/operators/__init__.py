"""Operators: DataFrame -> DataFrame, and predicates."""
