"""Operators over DataFrames of objects."""
