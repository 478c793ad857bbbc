"""Incremental versions of operators."""
