"""Pipelines of the two tracks, and the query catalogue."""
