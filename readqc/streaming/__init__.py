"""Streaming forms of the metrics over time."""
