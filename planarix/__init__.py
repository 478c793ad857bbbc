"""Spatial analytics of segmented objects as lazy Spark plans."""
