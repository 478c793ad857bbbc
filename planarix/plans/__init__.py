"""Fixture views, workflows and the query catalogue."""
